"""Bitmaps of subjects beside Python's sets."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest
from permitlake.operators import bitsets
from permitlake.plans import catalogue
from pyspark.sql import functions as F
from worlds import DATA

SETS = {
    "empty": set(),
    "one": {0},
    "edges": {-(2**40), -65, -64, -63, -1, 0, 1, 62, 63, 64, 127, 128, 2**40, 2**62},
    "full": set(range(0, 640)),
    "sparse": set(random.Random(1).sample(range(10**12), 300)),
    "half": {i for i in range(700) if random.Random(i).random() < 0.5},
}


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "subject long")


def back(bits):
    rows = [r[0] for r in bitsets.members(bits).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("name", SETS)
def test_round_trip_and_size(spark, name):
    """Repeated and null subjects change nothing."""
    bits = bitsets.bitset(frame(spark, [*SETS[name], *SETS[name], None]))
    assert back(bits) == SETS[name]
    assert bits.agg(bitsets.size(F.col("bits"))).first()[0] == len(SETS[name])


@pytest.mark.parametrize("a, b", [("edges", "full"), ("full", "half"), ("half", "full"), ("empty", "half"), ("half", "empty"), ("sparse", "sparse"), ("one", "edges")])
def test_algebra(spark, a, b):
    one, other = (bitsets.bitset(frame(spark, SETS[x])) for x in (a, b))
    assert back(bitsets.both(one, other)) == SETS[a] & SETS[b]
    assert back(bitsets.without(one, other)) == SETS[a] - SETS[b]
    assert back(bitsets.either(one, other)) == SETS[a] | SETS[b]
    assert bitsets.without(one, one).count() == 0  # no word without a member


def test_overlaps(spark):
    rows = [(n, s) for n, v in SETS.items() for s in v]
    sets = bitsets.bitset(spark.createDataFrame(rows, "purpose string, subject long"), "purpose")
    got = {(r["one"], r["other"]): (r["n_both"], r["n_only"], r["n_either"]) for r in bitsets.overlaps(sets, "purpose", list(SETS)).collect()}
    assert got == {(a, b): (len(x & y), len(x - y), len(x | y)) for a, x in SETS.items() for b, y in SETS.items()}


@pytest.mark.parametrize("most", [bitsets.BROADCAST_WORDS, 3])
@pytest.mark.parametrize("name", SETS)
def test_restrict(spark, name, most):
    """In the scan and, for a set beyond the bound, by a join; columns of other names stay, null subjects leave."""
    every = sorted(set().union(*SETS.values()))
    docs = spark.createDataFrame([(i, s, "w", "b") for i, s in enumerate([*every, None, *every[:50]])], "doc_id long, subject long, word string, bits string")
    found = bitsets.restrict(docs, bitsets.bitset(frame(spark, SETS[name])), most)
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [i for i, s in enumerate([*every, None, *every[:50]]) if s in SETS[name]]


def test_hidden_documents_leave_before_any_exchange(spark):
    plan = catalogue.QUERIES["q35_bitmap_candidates"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_size_of_a_million_subjects(spark, tmp_path):
    """A random half of a million subjects: near a bit each on disk, and a 64th of their rows."""
    bits = bitsets.bitset(spark.range(1_000_000).where(F.rand(1) < 0.5).select(F.col("id").alias("subject")))
    bits.orderBy("word").coalesce(1).write.parquet(str(tmp_path / "bits"))
    disk = sum(os.path.getsize(p) for p in Path(tmp_path / "bits").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "bits")).count() == 15_625
    assert disk < 300_000
