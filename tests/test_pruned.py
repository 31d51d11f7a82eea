"""Posting lists and dynamic pruning beside brute force."""

from __future__ import annotations

import math
import random
import re
import shutil
from collections import Counter
from pathlib import Path

import pytest
from permitlake.functions import vectors
from permitlake.operators import pruned
from permitlake.operators.candidates import Restricted
from permitlake.plans import catalogue
from permitlake.schemas import TOKEN
from permitlake.sources import index as stored_index
from permitlake.sources import postings
from pyspark.sql import functions as F
from worlds import DATA


def corpus(spark, path, n=600, seed=1):
    """Documents on twelve themes, some odd ones, and subjects of which half are permitted."""
    r = random.Random(seed)
    themes = [[f"t{k}w{i}" for i in range(25)] for k in range(12)]
    rows = [(0, 0, None), (1, 1, ""), (2, 2, "the of and"), (3, 3, "x"), (4, 4, "Ünïcode ÉCOLE-ly --dash a-b-c"), (5, 5, "t0w1 " * 3_000)]
    for i in range(6, n):
        k = r.randrange(12)
        words = [r.choice(themes[k]) if r.random() < 0.9 else f"rare{r.randrange(200)}" for _ in range(r.choice([1, 5, 40, 200]))]
        rows.append((i, i % 50, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, subject long, text string")
    index = docs.select("doc_id", "subject", vectors.counts(F.col("text")).alias("vec")).withColumn("norm", vectors.square(F.col("vec"))).persist()
    postings.make(docs.select("doc_id", "text"), index, path)
    return rows, index, postings.opened(spark, path)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    patch = pytest.MonkeyPatch()
    patch.setattr(postings, "BLOCK_BITS", 4)
    patch.setattr(postings, "LIST_DOCS", 100)
    yield corpus(spark, str(tmp_path_factory.mktemp("lists")))
    patch.undo()


@pytest.mark.parametrize("terms", [["t3w1"], ["e1", "école"], ["cole-ly"], ["b"], ["-b"], ["a-b-c"], ["dash"], ["the"], ["nowhere"], [], ["w"], ["rare19", "t0w1"]])
def test_terms_by_lists(world, terms):
    """Substrings of any length, stop words, several; a term as ``query_terms`` gives it."""
    rows, _, lists = world
    want = {i for i, _, t in rows if any(x in (t or "").lower() for x in terms)}
    if terms == ["école"] or "-b" in terms:
        want &= {4}
    got = {r["doc_id"] for r in postings.holding(lists, [t for t in terms if t.isascii()]).collect()}
    assert got == {i for i in want if any(x in (rows[i][2] or "").lower() for x in terms if x.isascii())}


def brute(index, query, terms, rows, permitted, k, threshold=0.55):
    length = math.sqrt(sum(w * w for w in query.values()))
    out = []
    for r in index.collect():
        inner = sum(r["vec"][b] * w for b, w in query.items())
        score = inner / (math.sqrt(r["norm"]) * length) if r["norm"] and length else 0.0
        if r["subject"] in permitted and (score > threshold or any(t in (rows[r["doc_id"]][2] or "").lower() for t in terms)):
            out.append((-round(score, 12), r["doc_id"]))
    return sorted(out)[:k], len(out)


@pytest.mark.parametrize("asked, terms, k, half", [(7, [], 10, True), (40, ["t1w"], 10, True), (100, ["rare1"], 30, False), (5, ["t0w1", "t5w"], 200, False), (2, ["rare"], 7, False), (3, ["zzz"], 5, True), (250, ["t"], 600, False)])
def test_pruned_search_is_exact(spark, world, asked, terms, k, half):
    rows, index, lists = world
    query = dict(Counter({b: w for b, w in enumerate(index.where(F.col("doc_id") == asked).first()["vec"]) if w}))
    permitted = set(range(0, 50, 2 if half else 1))
    people = Restricted(spark.createDataFrame([(s,) for s in permitted], "subject long"))
    found = pruned.best(lists, query, people, terms, k)
    want, _ = brute(index, query, terms, rows, permitted, k)
    assert sorted((-round(r["score"], 12), r["doc_id"]) for r in found.best.collect()) == want


def test_few_are_scored_and_none_hidden(spark, world):
    rows, index, lists = world
    vec = next(r["vec"] for r in index.where("norm > 500").orderBy("doc_id").collect() if r["doc_id"] > 5)
    query = {b: w for b, w in enumerate(vec) if w}
    people = Restricted(spark.createDataFrame([(s,) for s in range(0, 50, 2)], "subject long"))
    found = pruned.best(lists, query, people, ["t"], 10)
    _, matched = brute(index, query, ["t"], rows, set(range(0, 50, 2)), 10)
    scored = [r["subject"] for r in found.scored.collect()]
    assert len(scored) < matched / 4 and not any(s % 2 for s in scored)


def test_given_tables_by_pruning(spark):
    """Fewer documents are scored than match, in the registered query's own search."""
    asked = stored_index.stored(spark, DATA).where(F.col("doc_id") == catalogue.SEED_DOC).select(F.inline(vectors.entries(F.col("vec")))).collect()
    found = pruned.best(postings.postings(spark, DATA), {r["bucket"]: r["weight"] for r in asked}, Restricted(catalogue._consented(spark, DATA)), catalogue.TERMS, 3)
    assert found.scored.count() < catalogue._matched(spark, DATA).count() / 2


def test_no_text_is_read(spark):
    plan = catalogue.QUERIES["q13_hybrid"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "documents.parquet" not in plan


def test_index_is_made_anew_when_its_folder_is_gone(spark):
    stored_index.stored(spark, DATA).count()
    key = next(k for k in stored_index._STORED if k[1] == "index" and k[2] == DATA)
    shutil.rmtree(Path(stored_index._STORED[key].removeprefix("file:")))
    assert stored_index.stored(spark, DATA).count() == 200


def test_a_posting_is_stored_once(spark, world):
    """Lists hold each document of a token once, in rows of LIST_DOCS documents at most; blocks have one row per bucket."""
    rows, index, lists = world
    want = sorted((w, i) for i, _, t in rows for w in set(re.findall(TOKEN, (t or "").lower())))
    held = lists.lists.collect()
    assert sorted((r["token"], i) for r in held for i in r["docs"]) == want
    assert max(len(r["docs"]) for r in held) <= 100
    assert lists.impacts.count() == lists.impacts.select("bucket", "block").distinct().count()
    entries = {(r["bucket"], r["doc_id"], r["weight"]) for r in lists.impacts.select("bucket", F.inline("entries")).collect()}
    assert entries == {(b, r["doc_id"], w) for r in index.collect() for b, w in enumerate(r["vec"]) if w}


@pytest.fixture
def no_small_tables(spark):
    """Plans as for tables that Spark doesn't broadcast by their size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_vector_travels(spark, no_small_tables):
    found = plan(catalogue._matched(spark, DATA))
    assert "hashpartitioning(subject" not in found and "BroadcastHashJoin" in found


def test_vectors_of_other_blocks_do_not_travel(spark, world, no_small_tables):
    _, index, lists = world
    query = {b: w for b, w in enumerate(index.where("doc_id = 40").first()["vec"]) if w}
    found = pruned.best(lists, query, Restricted(spark.createDataFrame([(s,) for s in range(50)], "subject long")), ["t1w"], 10)
    assert "BroadcastHashJoin [block" in plan(found.scored)
