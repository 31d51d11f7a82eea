"""Hybrid search, ranking, paging, counts and strata over a candidate set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.functions.text import keyword_match, query_terms, stratum
from permitlake.functions.vectors import cosine, query_vector
from permitlake.operators.candidates import Restricted, Unrestricted, matches, restrict
from permitlake.schemas import MIN_SIMILARITY, STRATUM_FIELDS
from permitlake.sources.scratch import written


def hybrid(docs: DataFrame, candidates: Restricted | Unrestricted, query: str, strategy: str = "pinned", threshold: float = MIN_SIMILARITY) -> DataFrame:
    """Documents with a query term in the text or a similar vector, with their cosine score.

    ``docs`` has text and the vector column vec; the score is computed after the match.
    """
    score = cosine(F.col("vec"), query_vector(query))
    met = keyword_match(F.col("text"), query_terms(query)) | (score > threshold)
    return matches(docs, candidates, met, strategy).withColumn("score", score)


def page(scored: DataFrame, number: int, size: int, *keys: str) -> DataFrame:
    """A page by score, the best first, ties by doc_id; the score is rounded afterwards."""
    if number < 0:
        raise ValueError("pages are numbered from 0")
    best = scored.orderBy(F.desc("score"), F.asc("doc_id")).offset(number * size).limit(size)
    return best.withColumn("score", F.round("score", 6)).select("doc_id", "subject", "score", *keys)


def ranked(scored: DataFrame, *order: Column) -> DataFrame:
    """Every row with its rank (from 1) in a total order, without sorting in one task:
    ranges of the order, ranks within each, and the counts of the ranges before it."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = written(scored, "scored")  # dealing by ranges reads its input twice
    ranges = written(scored.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(W.orderBy("_part")) - F.col("n")).select("_part", "_before")  # a row per range
    inside = ranges.withColumn("rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return inside.join(before, "_part").withColumn("rank", F.col("rank") + F.col("_before")).drop("_part", "_before")


def walk(scored: DataFrame, size: int, max_pages: int) -> DataFrame:
    """Rows of every page that a walk reads: (page, rows, has_more, short).

    The walk stops after page ``max_pages``, as it tests for the end after reading.
    """
    rows = ranked(scored, F.desc("score"), F.asc("doc_id"))
    pages = rows.groupBy(F.floor((F.col("rank") - 1) / size).alias("page")).agg(F.count("*").alias("rows")).where(F.col("page") <= max_pages)
    total = rows.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("total"))  # one row
    out = pages.join(total, F.lit(True)).withColumn("has_more", (F.col("page") + 1) * size < F.col("total")).drop("total")
    return out.withColumn("short", F.col("has_more") & (F.col("rows") < size))


def count_by(docs: DataFrame, candidates: Restricted | Unrestricted, field: str) -> DataFrame:
    """Documents of the candidate set by one of the permitted fields."""
    if field not in STRATUM_FIELDS:
        raise ValueError(f"{field!r} is none of {', '.join(STRATUM_FIELDS)}")
    return restrict(docs, candidates).groupBy(field).agg(F.count("*").alias("documents")).orderBy(field)


def strata(docs: DataFrame, candidates: Restricted | Unrestricted) -> DataFrame:
    """Rows (stratum, size): the subjects of the candidate set in each cell of condition and region.

    Counts only, so that no task holds the members of a large cell.
    """
    members = stratum_members(docs, candidates)
    return members.groupBy("stratum").agg(F.count("*").alias("size"))


def stratum_members(docs: DataFrame, candidates: Restricted | Unrestricted) -> DataFrame:
    """Rows (stratum, subject), each once."""
    return restrict(docs, candidates).select(stratum(F.col("condition"), F.col("region")).alias("stratum"), "subject").distinct()


def context(hits: DataFrame) -> DataFrame:
    """One row: the texts of a page (rank, text), in its order, as a prompt would get them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text)
    return hits.agg(F.array_join(ordered, "\n\n").alias("context"))
