"""Candidate sets, and how a search is restricted to them.

``Restricted`` holds the subjects a query may see, ``Unrestricted`` is the
masking baseline's; there is no third value that could mean either.

Strategies: ``plain`` leaves the order of join and predicate to the optimizer,
which may score documents outside the set before it drops them. ``pinned`` (the
default) makes the predicate indeterminate to the optimizer, so that it stays
above the join and only documents of the set are scored, at no cost in
materialisation. ``partitioned`` needs documents written by subject bucket
(``write_by_subject``) and does not even read the buckets without a candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("plain", "pinned", "partitioned")
BUCKETS = 256


@dataclass(frozen=True)
class Restricted:
    subjects: DataFrame  #: one column, subject


@dataclass(frozen=True)
class Unrestricted:
    """Everything. Only a baseline without permissions constructs it."""


def restrict(docs: DataFrame, candidates: Restricted | Unrestricted) -> DataFrame:
    if isinstance(candidates, Unrestricted):
        return docs
    if not isinstance(candidates, Restricted):
        raise TypeError("a search needs a candidate set")
    return docs.join(candidates.subjects.select("subject"), "subject", "left_semi")


def pinned(predicate: Column) -> Column:
    """The predicate, in a form that the optimizer moves below no join.

    A random number under 1 is added to 1 or 0, which changes nothing but that the
    comparison is not deterministic; a conditional would be split into a conjunction.
    """
    return F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0)) + F.rand(0) >= 1.0


def bucket(subject: Column) -> Column:
    return F.pmod(F.xxhash64(subject), F.lit(BUCKETS)).cast("int")


def write_by_subject(docs: DataFrame, path: str) -> DataFrame:
    """Writes documents in folders by subject bucket and reads them back."""
    docs.withColumn("subject_bucket", bucket(F.col("subject"))).repartition("subject_bucket").write.partitionBy("subject_bucket").parquet(path)
    return docs.sparkSession.read.parquet(path)


def matches(docs: DataFrame, candidates: Restricted | Unrestricted, predicate: Column, strategy: str = "pinned") -> DataFrame:
    """The documents of the candidate set that meet the predicate."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "partitioned" and isinstance(candidates, Restricted):
        wanted = [r[0] for r in candidates.subjects.select(bucket(F.col("subject")).alias("b")).distinct().collect()]  # BUCKETS values
        docs = docs.where(F.col("subject_bucket").isin(*wanted) if wanted else F.lit(False))
    allowed = restrict(docs, candidates)
    return allowed.where(predicate if strategy == "plain" else pinned(predicate))
