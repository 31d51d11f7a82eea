"""Helpers that several operators share: table reading, scratch tables, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as characters and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a local folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared scratch folder and reads them back.

    This cuts the lineage in a way that survives lost executors, and lets
    several consumers share one computation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROW = "__row"


def carry(docs: DataFrame, made: tuple[str, ...], *needed: Column) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The needed columns beside the whole row as one, and what lays the row out again.

    So no column of a caller's can clash with an operator's own; columns named
    like those made are replaced.
    """
    own = [c for c in docs.columns if c not in made]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias(ROW), *needed)
    return packed, lambda df, *cols: df.select(*(F.col(ROW).getField(c).alias(c) for c in own), *cols)


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    core = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(core), F.lit(0)) > 0, F.split(core, SPACE_RUN)).otherwise(
        F.array().cast("array<string>")
    )
