"""Deep pages: a ranking is stored once, and any page of it is read from the range that holds it.

The rows are dealt by ranges of a total order, sorted in each, numbered there and
written with a folder for each range. The directory has the rows of each range; their
running sums, bisected, name the range of a page (two, where the page crosses a border).
Only that folder is read, and in its file the statistics of the row numbers leave out
all but a few pages' worth of rows. Nothing is sorted again, and no row before the page
is touched, however deep it lies.

The order has to be total (end it with doc_id). An empty ranking has no pages; a page
beyond the last is empty, a negative one is refused.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_ROWS = 200_000
_LOCAL_BITS = 33  #: of ``monotonically_increasing_id``, the row within its partition


@dataclass(frozen=True)
class Ranking:
    spark: SparkSession
    path: str
    schema: T.StructType
    parts: list[int]  #: the ranges with rows, in their order
    ends: list[int]  #: the rows up to the end of each: the directory, a number per range

    @staticmethod
    def write(rows: DataFrame, path: str, *order: Column, range_rows: int = RANGE_ROWS) -> Ranking:
        """Stores ``rows`` in the given order; ``rows`` should be cheap to count, or written before."""
        stored = _stored(rows.schema)
        parts = max(1, -(-rows.count() // range_rows))
        sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
        local = F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
        placed = sorted_rows.withColumns({"_part": F.shiftright("_id", _LOCAL_BITS).cast("int"), "_local": local}).drop("_id")
        placed.write.partitionBy("_part").parquet(f"{path}/rows")
        spark = rows.sparkSession
        counted = spark.read.schema(stored).parquet(f"{path}/rows").groupBy("_part").agg((F.max("_local") + 1).alias("rows"))
        counted.coalesce(1).write.parquet(f"{path}/directory")
        return Ranking.open(spark, path, rows.schema)

    @staticmethod
    def open(spark: SparkSession, path: str, schema: T.StructType) -> Ranking:
        held = sorted(tuple(r) for r in spark.read.schema("_part int, rows long").parquet(f"{path}/directory").collect())  # a row per range
        return Ranking(spark, path, schema, [p for p, _ in held], list(accumulate(n for _, n in held)))

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def pages(self, size: int) -> int:
        return -(-self.total // size)

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of a page with their rank (from 1)."""
        if number < 0 or size < 1:
            raise ValueError("pages are numbered from 0 and hold a row at least")
        first, end = number * size, min((number + 1) * size, self.total)
        i = bisect_right(self.ends, first)
        every = self.spark.read.schema(_stored(self.schema)).parquet(f"{self.path}/rows")
        found = every.where(F.lit(False)).withColumn("rank", F.lit(0).cast("long"))
        while first < end:
            before = self.ends[i] - self._rows(i)
            stop = min(end, self.ends[i])
            piece = every.where((F.col("_part") == self.parts[i]) & (F.col("_local") >= first - before) & (F.col("_local") < stop - before))
            found = found.unionByName(piece.withColumn("rank", F.col("_local") + (before + 1)))
            first, i = stop, i + 1
        return found.select(*self.schema.names, "rank")

    def _rows(self, i: int) -> int:
        return self.ends[i] - (self.ends[i - 1] if i else 0)


def _stored(schema: T.StructType) -> T.StructType:
    if any(n in ("_part", "_local", "_id", "rank") for n in schema.names):
        raise ValueError("_part, _local, _id and rank are names of the ranking's own columns")
    return T.StructType([*schema.fields, T.StructField("_local", T.LongType()), T.StructField("_part", T.IntegerType())])
