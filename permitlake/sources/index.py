"""The stored index: every document's bucket counts and their sum of squares, made once for a corpus.

It is written to the shared folder and read by every search after that, for as
long as the application runs and the files of the tables are the same (their
number, sizes and newest time; listing them reads no content).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.functions import vectors
from permitlake.sources import tables
from permitlake.sources.scratch import folder

SCHEMA = "doc_id long, subject long, vec array<int>, norm long"
_STORED: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    listed = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("t"), "length", "modificationTime") for t in ("documents", "customer")]
    every = listed[0].unionByName(listed[1]).groupBy("t").agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.max("modificationTime").cast("string").alias("newest"))
    return tuple(sorted(tuple(r) for r in every.collect()))  # two rows


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], str]) -> str:
    """The path of something made for a corpus; made anew when the corpus has changed or the path is gone."""
    key = (spark.sparkContext.applicationId, name, sf_dir, _state(spark, sf_dir))
    if key in _STORED:
        try:
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_STORED[key])
        except AnalysisException:
            del _STORED[key]  # the scratch folder was cleared
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, subject, vec, norm) of all documents."""

    def made() -> str:
        path = folder(spark, "index")
        rows = tables.owned(spark, sf_dir).select("doc_id", "subject", vectors.counts(F.col("text")).alias("vec"))
        rows.withColumn("norm", vectors.square(F.col("vec"))).write.parquet(path)
        return path

    return spark.read.schema(SCHEMA).parquet(kept(spark, sf_dir, "index", made))
