"""How many subjects permit a purpose, at every instant: a sweep over the ends of permissions.

The permissions of a subject's highest version are intervals [from, until), cut by
revocation. Per subject and purpose they are made disjoint: each keeps what lies
after the ends of all that begin before it. What is left gives +1 where it begins
and -1 where it ends, and the running sum over all instants is the answer as a step
function. Many instants are answered by putting them into the same sweep with a 0, so
instants are joined with no row; one instant is looked up in the stored steps by a
directory of their ranges.

Neither a subject with very many permissions nor a purpose with very many instants
is one task's work: rows are dealt by ranges of the whole order, worked on within each
range, and what the ranges before hand over is a row per range.

Rows without subject or beginning, intervals that end before they begin, and ledgers
without a row give no step. Before its first step a purpose has the count 0.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.functions import decide
from permitlake.schemas import Purpose, aware
from permitlake.sources.scratch import folder, written

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def intervals(ledger: DataFrame) -> DataFrame:
    """Rows (purpose, subject, start, stop) of the latest rows, one per start; stop is null where there is no end."""
    stop = F.least("valid_until", "revoked_at")  # the one that is there, if only one is
    known = F.array(*(F.lit(p.value) for p in Purpose))
    rows = decide.latest(ledger).where(F.col("subject").isNotNull() & F.col("valid_from").isNotNull())
    rows = rows.select(F.explode(F.array_intersect("purposes", known)).alias("purpose"), "subject", F.col("valid_from").alias("start"), stop.alias("stop"))
    rows = rows.where(F.col("stop").isNull() | (F.col("start") < F.col("stop")))
    latest = F.when(F.bool_or(F.col("stop").isNull()), F.lit(None)).otherwise(F.max("stop")).alias("stop")
    return rows.groupBy("purpose", "subject", "start").agg(latest)


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in ranges of an order, each with the number of its range, ``_part``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "sweep")


def _before(rows: DataFrame, keys: list[str], order: str, aggregate: Callable[[Column | str], Column], value: str, own: bool) -> DataFrame:
    """``_before``: the aggregate of ``value`` over the rows of the same keys earlier in the order (``own``: and this one).

    ``rows`` are ranges of (keys, order). Within a range a window has the answer; across
    ranges it is an aggregate of the ranges' aggregates. Only keys that a border
    cuts get anything handed over: a row per range at most.
    """
    frame = W.partitionBy(*keys, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    totals = rows.groupBy(*keys, "_part").agg(aggregate(value).alias("_total"))
    across = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    handed = totals.withColumn("_handed", aggregate("_total").over(across)).where(F.col("_handed").isNotNull()).drop("_total")
    inside = rows.withColumn("_inside", aggregate(value).over(frame))
    joined = inside.join(handed, [*keys, "_part"], "left")
    return joined.withColumn("_before", _of_two(aggregate, F.col("_inside"), F.col("_handed"))).drop("_inside", "_handed")


def _of_two(aggregate: Callable, a: Column, b: Column) -> Column:
    """The aggregate (``F.max`` or ``F.sum``) of two values, either of which may be null."""
    if aggregate is F.max:
        return F.greatest(a, b)
    return F.coalesce(a + b, a, b)


def changes(spans: DataFrame) -> DataFrame:
    """Rows (purpose, at, delta): how many subjects more permit the purpose from an instant on.

    ``spans`` are ``intervals``.
    """
    # an interval without end covers all that begins later: its end is the greatest that there is
    rows = _ranges(spans.select("purpose", "subject", "start", F.struct(F.col("stop").isNull().alias("never"), "stop").alias("end")), "purpose", "subject", "start")
    seen = _before(rows, ["purpose", "subject"], "start", F.max, "end", own=False)
    reached = F.col("_before")
    alone = seen.where(reached.isNull() | (~reached.never & (F.col("end.never") | (reached.stop < F.col("end.stop")))))
    begins = F.greatest("start", F.col("_before.stop"))
    ends = F.array(F.struct(begins.alias("at"), F.lit(1).cast("long").alias("delta")), F.struct(F.col("end.stop").alias("at"), F.lit(-1).cast("long").alias("delta")))
    return alone.select("purpose", F.inline(ends)).where(F.col("at").isNotNull()).groupBy("purpose", "at").agg(F.sum("delta").alias("delta"))


def _summed(rows: DataFrame) -> DataFrame:
    """Rows (purpose, at, permitted, delta, _part, ...) with the running sum of ``delta``."""
    return _before(_ranges(rows, "purpose", "at"), ["purpose"], "at", F.sum, "delta", own=True).withColumnRenamed("_before", "permitted")


def counts_at(changed: DataFrame, instants: DataFrame) -> DataFrame:
    """Rows (purpose, at, permitted) for every purpose and each of the instants (column at), each once.

    The instants enter the sweep with a change of 0.
    """
    every = F.explode(F.array(*(F.lit(p.value) for p in Purpose))).alias("purpose")
    asked = instants.where(F.col("at").isNotNull()).select(every, "at", F.lit(0).cast("long").alias("delta"), F.lit(True).alias("asked"))
    both = changed.withColumn("asked", F.lit(False)).unionByName(asked)
    each = both.groupBy("purpose", "at").agg(F.sum("delta").alias("delta"), F.bool_or("asked").alias("asked"))
    return _summed(each).where("asked").select("purpose", "at", "permitted")


@dataclass(frozen=True)
class Timeline:
    """Stored steps in ranges of (purpose, at), and where each range begins."""

    spark: SparkSession
    path: str
    directory: dict[str, list[tuple[int, int]]]  #: per purpose, the first instant in each range (microseconds) and the range's number

    @staticmethod
    def write(changed: DataFrame, path: str) -> None:
        rows = _summed(changed).where("delta != 0").select("purpose", "at", "permitted", "_part")
        rows.repartition("_part").sortWithinPartitions("_part", "purpose", "at").write.partitionBy("_part").parquet(f"{path}/steps")
        begun = changed.sparkSession.read.schema("purpose string, at timestamp, permitted long, _part int").parquet(f"{path}/steps")
        begun.groupBy("purpose", "_part").agg(F.min(F.unix_micros("at")).alias("at")).coalesce(1).write.parquet(f"{path}/directory")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Timeline:
        found: dict[str, list[tuple[int, int]]] = {}
        for r in sorted(spark.read.parquet(f"{path}/directory").collect(), key=lambda r: (r["purpose"], r["at"])):  # a row per range and purpose in it
            found.setdefault(r["purpose"], []).append((r["at"], r["_part"]))
        return Timeline(spark, path, found)

    @staticmethod
    def make(spark: SparkSession, ledger: DataFrame) -> Timeline:
        path = folder(spark, "timeline")
        Timeline.write(changes(intervals(ledger)), path)
        return Timeline.open(spark, path)

    def range_of(self, purpose: Purpose, when: datetime) -> int | None:
        """The one range that holds the last step at or before the instant: a binary search."""
        ranges = self.directory.get(Purpose.parse(purpose).value, [])
        i = bisect_right([at for at, _ in ranges], (aware(when) - EPOCH) // timedelta(microseconds=1))
        return ranges[i - 1][1] if i else None

    def steps(self, purpose: Purpose, when: datetime) -> DataFrame:
        """The steps at or before the instant, of its range alone: one folder is read."""
        part = self.range_of(purpose, when)
        every = self.spark.read.schema("purpose string, at timestamp, permitted long, _part int").parquet(f"{self.path}/steps")
        at = F.lit(when).cast("timestamp")
        return every.where((F.col("_part") == (-1 if part is None else part)) & (F.col("purpose") == Purpose.parse(purpose).value) & (F.col("at") <= at))

    def permitted(self, purpose: Purpose, when: datetime) -> int:
        """The subjects that permit the purpose at an instant."""
        return self.steps(purpose, when).agg(F.max_by("permitted", "at").alias("n")).first()["n"] or 0
