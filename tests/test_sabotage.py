"""Deliberate breakages, each of which has to show."""

from __future__ import annotations

import pytest
from permitlake.functions import decide
from permitlake.operators import candidates as C
from permitlake.operators.caches import CachedGate, StampedCache
from permitlake.operators.gates import ExclusionGate, Response
from permitlake.schemas import Purpose
from permitlake.sources.ledger import Ledger
from pyspark.sql import functions as F
from worlds import CARE, DAY, NOW, docs


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    ledger = Ledger(spark, str(tmp_path_factory.mktemp("sabotage") / "ledger"))
    ledger.record("PA", [CARE], NOW - 9 * DAY)
    ledger.record("PB", [CARE], NOW - 9 * DAY, revoked_at=NOW - DAY)
    ledger.record("PC", [CARE], NOW - 9 * DAY, valid_until=NOW - DAY)
    ledger.record("PD", [Purpose.RESEARCH], NOW - 9 * DAY)
    return ledger, docs(spark, [(f"D{s}", s, f"note with ZZ-{s} inside") for s in ("PA", "PB", "PC", "PD")])


def found(world, token):
    return ExclusionGate(*world).search(token, purpose=CARE, at=NOW).count


def test_whole_engine_hides(world):
    assert [found(world, f"ZZ-{s}") for s in ("PA", "PB", "PC", "PD", "NONE")] == [1, 0, 0, 0, 0]


def test_ignoring_revocation_shows(world, monkeypatch):
    monkeypatch.setattr(decide, "active", lambda when: (F.col("valid_from") <= when) & (F.col("valid_until").isNull() | (when < F.col("valid_until"))))
    assert found(world, "ZZ-PB") == 1


def test_ignoring_expiry_shows(world, monkeypatch):
    monkeypatch.setattr(decide, "active", lambda when: (F.col("valid_from") <= when) & (F.col("revoked_at").isNull() | (when < F.col("revoked_at"))))
    assert found(world, "ZZ-PC") == 1


def test_ignoring_the_purpose_shows(world, monkeypatch):
    monkeypatch.setattr(decide, "covers", lambda purpose, scope=None: F.lit(True))
    assert found(world, "ZZ-PD") == 1


def test_filtering_after_ranking_shows(world):
    """Counts over everything with hits filtered afterwards differ from an absent token's."""
    ledger, all_docs = world
    hits = C.matches(all_docs, C.Unrestricted(), F.lower("text").contains("zz-pb"))
    late = Response(count=hits.count())
    assert late.fingerprint() != Response(count=0).fingerprint()


def test_an_unstamped_cache_serves_stale(spark, world, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "stale"))
    ledger.record("PA", [CARE], NOW - DAY)
    cached = CachedGate(ExclusionGate(ledger, world[1]))
    monkeypatch.setattr(StampedCache, "get", lambda self, key, stamp: self.kept.get((key, self.current.get(key))))
    assert cached.search("ZZ-PA", purpose=CARE, at=NOW).count == 1
    ledger.revoke("PA", NOW)
    assert cached.search("ZZ-PA", purpose=CARE, at=NOW).count == 1  # the sabotage, seen


def test_failing_open_shows(world, monkeypatch):
    monkeypatch.setattr(ExclusionGate, "candidates", lambda self, *a: C.Unrestricted())
    assert found(world, "ZZ-PB") == 1


def test_no_candidate_set_is_an_error(world):
    with pytest.raises(TypeError):
        C.restrict(world[1], None)


def scored_rows(spark, all_docs, subjects, strategy):
    """How many documents the predicate is computed for, and how many it returns."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(text):
        calls.add(1)
        return len(text) % 2 == 0

    n = C.matches(all_docs, C.Restricted(subjects), seen("text"), strategy).count()
    return calls.value, n


def test_only_pinned_scores_candidates_alone(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id as string) doc_id", "id % 100 subject", "repeat('x', cast(id % 7 as int)) text").write.parquet(str(tmp_path / "docs"))
    spark.range(40).selectExpr("id * 2 subject").write.parquet(str(tmp_path / "cand"))
    all_docs, subjects = spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "cand"))
    plain, n1 = scored_rows(spark, all_docs, subjects, "plain")
    pinned, n2 = scored_rows(spark, all_docs, subjects, "pinned")
    by_subject = C.write_by_subject(all_docs, str(tmp_path / "buckets"))
    parted, n3 = scored_rows(spark, by_subject, subjects, "partitioned")
    assert n1 == n2 == n3 > 0
    assert pinned == 400 and parted == 400 and plain == 1000


def test_partitioned_reads_only_wanted_buckets(spark, tmp_path):
    all_docs = spark.range(1000).selectExpr("cast(id as string) doc_id", "id subject", "'x' text")
    by_subject = C.write_by_subject(all_docs, str(tmp_path / "b"))
    few = spark.range(3).selectExpr("id subject")
    found = C.matches(by_subject, C.Restricted(few), F.lit(True), "partitioned")
    assert found.count() == 3 and "PartitionFilters: [subject_bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_registered_searches_score_permitted_documents_alone(spark, monkeypatch):
    """The inner product is computed once for each permitted document, and for no other."""
    from permitlake.functions import vectors
    from permitlake.plans import catalogue
    from permitlake.sources.index import stored
    from worlds import DATA

    index = stored(spark, DATA)
    permitted = C.restrict(index, C.Restricted(catalogue._consented(spark, DATA))).count()
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(vec, asked):
        calls.add(1)
        return sum(vec[e["bucket"]] * e["weight"] for e in asked)

    monkeypatch.setattr(vectors, "dot", counted)
    n = catalogue.q13(spark, DATA).count()
    assert 0 < n <= calls.value == permitted < index.count()
