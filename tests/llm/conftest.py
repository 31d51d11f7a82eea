from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: A document table with a column that is named like results of several operators.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("score", T.StringType()), T.StructField("_id", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, *(rest + ["en", "src0"][len(rest) :]), "own", "other") for i, t, *rest in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and blank texts, a very long one, repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    return documents([(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "a b c"), (5, "a b c"), (None, "no id here"), (None, None), (6, "x", None, None), (7, "9" * 5_000 + " +" + "(" * 5_000 + " a" * 30)])
