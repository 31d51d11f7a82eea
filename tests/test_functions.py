"""Texts, vectors, pseudonyms and patterns."""

from __future__ import annotations

import hmac
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from permitlake.functions import detect, identity, text, vectors
from pyspark.sql import functions as F


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())] if row else [(1,)], list(row) or ["x"]).select(column).first()[0]


def test_tokens_and_keywords(spark):
    assert value(spark, text.tokens(F.col("t")), t="The Cat-1, a CAT-1 of dÉf") == ["cat-1", "cat-1", "d", "f"]
    assert value(spark, text.tokens(F.col("t")), t="") == []
    assert text.query_terms("Follow up, the ROUTINE") == ["follow", "up", "routine"]
    assert value(spark, text.keyword_match(F.col("t"), ["out"]), t="ROUTine") is True
    assert value(spark, text.keyword_match(F.col("t"), []), t="x") is False


def test_mask_counts_code_points(spark):
    spans = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for k, a, b in (("name", 0, 2), ("phone", 4, 5))))
    assert value(spark, text.mask(F.col("t"), spans), t="😀b-é9z") == "[NAME]-é[PHONE]z"
    assert value(spark, text.mask(F.col("t"), F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")), t="ab") == "ab"


def test_narrative_story_and_drill(spark):
    assert value(spark, text.narrative(F.col("t")), t="Name: x\nRecord type: note\n\n  body here \n") == "body here"
    assert value(spark, text.narrative(F.col("t")), t=" no header ") == "no header"
    assert value(spark, text.story_query(F.col("t"), F.lit(0), F.lit(20), F.array(F.lit("Ann"))), t="Ann  the  baker Ann and more") == "the baker"
    assert value(spark, text.drill_query(F.col("t")), t="x1 one, two three four five six") == "two three four five"
    assert value(spark, text.drill_query(F.col("t")), t="1 2 3") == "review"
    assert value(spark, text.quote(F.col("t"), 5), t="a\nbcdefg") == "a bcd"


def test_dense_vectors(spark):
    df = spark.createDataFrame([("routine review",), ("",), (None,)], "t string").select(vectors.embed(F.col("t")).alias("v"), vectors.cosine(vectors.embed(F.col("t")), vectors.query_vector("review")).alias("s"))
    one, two, three = df.collect()
    assert abs(one["s"] - 2**-0.5) < 1e-6 and two["s"] == 0.0 == three["s"]
    assert vectors.query_vector("the of") == {} and value(spark, vectors.cosine(F.array(F.lit(1.0)), {})) == 0.0


def test_stored_counts(spark):
    import hashlib

    df = spark.createDataFrame([("a routine review, routine the",), ("",), (None,)], "t string").select(vectors.counts(F.col("t")).alias("v"))
    at = lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % 1024
    one, two, three = [r[0] for r in df.select(vectors.entries(F.col("v"))).collect()]
    assert {e["bucket"]: e["weight"] for e in one} == {at("routine"): 2, at("review"): 1} and two == [] == three
    assert [r[0] for r in df.select(vectors.square(F.col("v"))).collect()] == [5, 0, 0]


def test_narrative_hits_by_brute_force(spark):
    import random

    from permitlake.operators import probes

    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
    docs = [(i, i % 7, say(rng.randrange(0, 5))) for i in range(300)]
    index = spark.createDataFrame(docs, "doc_id long, subject long, text string").select("doc_id", "subject", vectors.counts(F.col("text")).alias("vec")).withColumn("norm", vectors.square(F.col("vec")))
    asked = [(i, say(3)) for i in range(9)] + [(99, "")]
    allowed = spark.createDataFrame([(1,), (4,)], "subject long")
    want = set()
    for probe, text_ in asked:
        q = {w: text_.split().count(w) for w in text_.split()}
        scores = []
        for i, s, t in docs:
            d = {w: t.split().count(w) for w in t.split()}
            inner = sum(c * d.get(w, 0) for w, c in q.items())
            if inner:
                scores.append((-round(inner / (sum(c * c for c in q.values()) * sum(c * c for c in d.values())) ** 0.5, 6), i, s))
        for name, own in (("masking", scores), ("exclusion", [x for x in scores if x[2] in (1, 4)])):
            want |= {(name, probe, r, i, s not in (1, 4)) for r, (_, i, s) in enumerate(sorted(own)[:4], 1)}
    for block, rows in ((100, 2048), (3, 7)):
        got = probes.narrative_hits(index.repartition(3), spark.createDataFrame(asked, "probe_id long, text string"), allowed, 4, block, rows).collect()
        assert {(r["configuration"], r["probe_id"], r["rank"], r["doc_id"], r["hidden"]) for r in got} == want


def test_mail_spans(spark):
    t = "xa@b.co a@b.co, a@b.co! no@ @no a@b.co.uk"
    spans = value(spark, detect.email_spans(F.col("t")), t=t)
    assert [t[s["start"] : s["end"]] for s in spans] == ["xa@b.co", "a@b.co", "a@b.co", "a@b.co.uk"]
    assert value(spark, text.mask(F.col("t"), detect.email_spans(F.col("t"))), t=t) == "[EMAIL] [EMAIL], [EMAIL]! no@ @no [EMAIL]"
    for pack, name, regex, *_ in detect.PATTERNS:  # what a match needs is part of the pattern
        assert all(any(c in regex for c in (x, x.replace("_", ""))) for x in detect.NEEDS.get(name, ())), name


def test_pseudonym_is_hmac(spark):
    for key in (b"k", b"x" * 100):
        assert value(spark, identity.pseudonym(F.col("t"), key), t="P001é") == hmac.new(key, "P001é".encode(), "sha256").hexdigest()[:32]
    with pytest.raises(ValueError):
        identity.pads(b"")


def test_key_from_env(monkeypatch):
    monkeypatch.delenv(identity.KEY_VARIABLE, raising=False)
    with pytest.raises(ValueError):
        identity.key_from_env()
    monkeypatch.setenv(identity.KEY_VARIABLE, "k")
    assert identity.key_from_env() == b"k"


def test_patterns(spark):
    df = spark.createDataFrame([("ssn 123-45-6789, mail a.b@c.org",), (None,), ("api_key = 'abcdefghij0123456789'",)], "text string")
    hits = {r["pattern"]: r["documents"] for r in detect.hits(df).collect()}
    assert hits["ssn"] == 1 and hits["email-bulk"] == 1 and hits["api-keys"] == 1 and hits["credit-card"] == 0
    assert detect.sensitive_columns(spark.createDataFrame([(1, 2)], ["dob", "x"])) == {"dob": ("healthcare", "dob", "high", "warn")}


ADDRESS_PARTS = st.sampled_from(["a", "b1", ".", "co", "com", "@", "_", " ", "-", "é", "1", "%", "\n"])


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.lists(ADDRESS_PARTS, max_size=24).map("".join), min_size=20, max_size=40))
def test_mail_spans_are_where_the_matches_are(spark, texts):
    texts += ["a@b.co1 then a@b.co end", "x@y.org_ x@y.org", "", "@", "a@b.co,a@b.co", "a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r for r in df.select("i", detect.email_spans(F.col("text")).alias("s"), text.mask(F.col("text"), detect.email_spans(F.col("text"))).alias("m")).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["end"]) for s in got[i]["s"]] == [m.span() for m in re.finditer(detect.EMAIL, t)]
        assert got[i]["m"] == re.sub(detect.EMAIL, "[EMAIL]", t)


def test_counts_hold_few_rows(monkeypatch):
    """A worker gives vectors on in small parts, in the texts' order, and forgets tokens beyond a limit; the counts stay the same."""
    import pandas as pd

    texts = [f"routine w{i} w{i} review w{i % 7}" if i % 5 else None for i in range(1_000)]
    monkeypatch.setattr(vectors, "COUNTS_ROWS", 64)
    want = [v.tolist() for part in vectors.counted(iter([pd.Series(texts)])) for v in part]
    monkeypatch.setattr(vectors, "COUNTS_KEPT", 50)
    parts = list(vectors.counted(iter([pd.Series(texts[:900]), pd.Series(texts[900:]), pd.Series([], dtype=object)])))
    assert max(map(len, parts)) <= 64 and [v.tolist() for part in parts for v in part] == want
    assert [sum(v) for v in want] == [5 if t else 0 for t in texts]


def test_counts_take_few_texts(spark, monkeypatch):
    """Of an Arrow batch only a few texts are Python's at a time, each part taken after the last has gone; the counts stay the same."""
    import pandas as pd
    import pyarrow as pa

    texts = [f"routine w{i} w{i} überall-{i % 7}" if i % 5 else None for i in range(1_000)]
    want = [v.tolist() for v in pd.concat(vectors.counted(iter([pd.Series(texts)])))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", vectors.counts(F.col("t")).alias("v"))
    assert [r["v"] for r in rows.orderBy("i").collect()] == want and rows.where("i < 0").collect() == []

    monkeypatch.setattr(vectors, "COUNTS_ROWS", 64)
    taken, plain = [], vectors.counted
    monkeypatch.setattr(vectors, "counted", lambda parts: plain(taken.append(len(p)) or p for p in parts))
    got = []
    for part in vectors.counted_arrays(iter([pa.array(texts[:900]), pa.array([], pa.string()), pa.array(texts).slice(900), pa.nulls(70, pa.string())])):
        got += part.to_pylist()
        assert len(part) <= 64 and sum(taken) == len(got)
    assert max(taken) <= 64 and got == want + [[0] * vectors.DIMENSIONS] * 70


def test_probe_matrices_are_small():
    import inspect

    from permitlake.operators import probes

    assert inspect.signature(probes.narrative_hits).parameters["rows"].default * vectors.DIMENSIONS * 8 <= 4 << 20


def test_ranking_works_out_its_input_once(spark):
    from permitlake.operators import retrieval

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(i):
        seen.add(1)
        return float(i % 7)

    rows = spark.range(0, 100, 1, 4).select(F.col("id").alias("doc_id"), scored("id").alias("score"))
    got = {r["doc_id"]: r["rank"] for r in retrieval.ranked(rows, F.desc("score"), F.asc("doc_id")).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(100), key=lambda i: (-(i % 7), i)), 1)} and seen.value == 100
