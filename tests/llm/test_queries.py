"""Registered queries that SQL can express, beside DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest
from permitlake.llm import queries
from worlds import DATA

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(round(v, 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", queries.SQL)
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = c.execute(queries.SQL[name])
    columns = [x[0] for x in rows.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(plain(v) for v in r) for r in rows.fetchall()) == sorted(tuple(plain(r[x]) for x in columns) for r in got.collect())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
