"""A stored ranking's pages beside a sorted list."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from permitlake.operators.pages import Ranking
from pyspark.sql import functions as F


def made(spark, path, n, range_rows):
    r = random.Random(n)
    rows = [(i, r.choice([0.0, 0.5, r.random()]), r.choice(["a", None])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, score double, text string")
    ranking = Ranking.write(df, str(path / "ranking"), F.desc("score"), F.asc("doc_id"), range_rows=range_rows)
    return sorted(rows, key=lambda x: (-x[1], x[0])), ranking


@pytest.mark.parametrize("n, range_rows, size", [(2_000, 150, 10), (997, 40, 100), (30, 1_000, 7)])
def test_every_kind_of_page(spark, tmp_path, n, range_rows, size):
    """First, last, beyond, and those that cross borders between ranges; the same when opened again."""
    want, ranking = made(spark, tmp_path, n, range_rows)
    assert ranking.total == n and ranking.pages(size) == -(-n // size)
    assert n < range_rows or len(ranking.parts) > n / range_rows / 2
    crossing = [e // size for e in ranking.ends[:-1] if e % size][:2]
    again = Ranking.open(spark, ranking.path, ranking.schema)
    for k in {0, ranking.pages(size) // 2, ranking.pages(size) - 1, ranking.pages(size), *crossing}:
        got = sorted(again.page(k, size).collect(), key=lambda r: r["rank"])
        assert [tuple(r) for r in got] == [(*w, k * size + i + 1) for i, w in enumerate(want[k * size : (k + 1) * size])]


def test_a_page_reads_one_range(spark, tmp_path):
    """Page 10,000: one folder of the stored rows, rows left out by their numbers, nothing sorted or shuffled."""
    df = spark.range(120_000).select(F.col("id").alias("doc_id"), F.rand(3).alias("score")).persist()
    ranking = Ranking.write(df, str(tmp_path / "ranking"), F.desc("score"), F.asc("doc_id"), range_rows=10_000)
    page = ranking.page(10_000, 10)
    want = df.orderBy(F.desc("score"), F.asc("doc_id")).offset(100_000).limit(10).collect()
    assert [(r["doc_id"], r["score"]) for r in sorted(page.collect(), key=lambda r: r["rank"])] == [(r["doc_id"], r["score"]) for r in want]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "GreaterThanOrEqual(_local" in plan
    at = next(i for i, e in enumerate(ranking.ends) if e > 100_000)
    assert "(_part#" in plan and f"= {ranking.parts[at]})" in plan
    assert len(list(Path(ranking.path, "rows", f"_part={ranking.parts[at]}").glob("*.parquet"))) == 1
    df.unpersist()


def test_no_rows_and_bad_pages(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, score double")
    ranking = Ranking.write(none, str(tmp_path / "none"), F.desc("score"), F.asc("doc_id"))
    assert ranking.total == ranking.pages(10) == 0 and ranking.page(0, 10).count() == 0
    for bad in ((-1, 10), (0, 0)):
        with pytest.raises(ValueError, match="numbered from 0"):
            ranking.page(*bad)
    with pytest.raises(ValueError, match="own columns"):
        Ranking.write(none.withColumn("rank", F.lit(1)), str(tmp_path / "clash"), F.asc("doc_id"))
