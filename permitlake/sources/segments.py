"""A table of documents that takes upserts and deletes: segments of buckets, and manifests that name them.

A document belongs to the bucket of its id's hash (not its subject's: a subject may
own a third of all documents, and an upsert need not know the earlier subject). A
write adds one segment, with folders for the buckets it touches and no others. A
manifest, numbered from 0, is a snapshot: for each bucket the segment that is its
base, and the later segments (deltas) in their order. ``compact`` merges the deltas
of the buckets that have any into new bases; the other buckets' files stay.

All state is in files, so any application opens the table as it is. A manifest
appears whole under a number that only one writer gets (``Folder.publish``); a
writer who was slower puts its change on top of the other's. A write that fails
leaves a segment that no manifest names. Readers keep the snapshot they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitlake.functions import vectors
from permitlake.sources.history import LOG, Folder, History

KEY = "doc_id"
BUCKETS = 64


class TableMoved(Exception):
    """Two compactions met on the same bucket; the later one has changed nothing."""


class DocumentTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(self.path)
        self.log = History(self.folder)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS) -> DocumentTable:
        """An empty table for rows with a doc_id; columns need types that can be ordered. Creating one that exists is refused."""
        if KEY not in schema.names or any(n.startswith("_") for n in schema.names):
            raise ValueError("a table needs doc_id, and no column that begins with _")
        table = cls(spark, path)
        if not table._publish(0, {"schema": schema.jsonValue(), "buckets": buckets, "base": {}, "deltas": [], "oldest": 0}):
            raise FileExistsError(path)
        return table

    # snapshots

    def version(self) -> int:
        """The number of the newest manifest."""
        n = self.log.size()
        if not n:
            raise FileNotFoundError(self.path)
        return n - 1

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        newest = self.version()
        version = newest if version is None else version
        if not self.log.record(newest)["oldest"] <= version <= newest:
            raise ValueError(f"there is no snapshot {version}")
        return self.log.record(version)

    def _publish(self, number: int, manifest: dict[str, Any]) -> bool:
        return self.folder.publish(f"{LOG}/{number:020d}.json", json.dumps(manifest | {"number": number}).encode())

    def _advance(self, change: Callable[[dict[str, Any]], dict[str, Any]]) -> int:
        """Publishes a change to the newest manifest, on top of whatever others publish meanwhile."""
        while True:
            number = self.version()
            if self._publish(number + 1, change(self.log.record(number))):
                return number + 1

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The table's rows, each doc_id once."""
        return self._rows(self.manifest(version), None)

    def rows_of(self, ids: Sequence[Any], version: int | None = None) -> DataFrame:
        """The rows of some ids (a page of hits); only the buckets that they belong to are read."""
        m = self.manifest(version)
        kind = T.StructType([T.StructField(KEY, T.StructType.fromJson(m["schema"])[KEY].dataType)])
        wanted = self.spark.createDataFrame([(i,) for i in ids], kind)
        places = {str(r[0]) for r in wanted.select(_bucket(m)).distinct().collect()}  # as many as ids
        return self._rows(m, places).where(F.col(KEY).isin(list(ids)))

    def _rows(self, m: dict[str, Any], only: set[str] | None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        inside = lambda b: only is None or b in only
        deltas = [[s, [b for b in held if inside(b)]] for s, held in m["deltas"]]
        dirty = {b for _, held in deltas for b in held}
        clean = self._read(schema, [(s, b) for b, s in m["base"].items() if inside(b) and b not in dirty])
        if not dirty:
            return clean.select(*schema.names)
        below = self._read(schema, [(s, b) for b, s in m["base"].items() if b in dirty])
        changed = [self._read(schema, [(s, b) for b in held]).withColumn("_seq", F.lit(i)) for i, (s, held) in enumerate(deltas) if held]
        every = reduce(DataFrame.unionByName, changed)
        last = every.groupBy(KEY).agg(F.max_by(F.struct("_gone", *(c for c in schema.names if c != KEY)), "_seq").alias("_row"))
        above = last.where(~F.col("_row._gone")).select(*(F.col(c) if c == KEY else F.col("_row").getField(c).alias(c) for c in schema.names))
        kept = below.join(every.select(KEY).distinct(), KEY, "left_anti")
        return clean.select(*schema.names).unionByName(kept.select(*schema.names)).unionByName(above)

    def _read(self, schema: T.StructType, places: list[tuple[str, str]]) -> DataFrame:
        stored = T.StructType([*schema.fields, T.StructField("_gone", T.BooleanType())])
        if not places:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*(f"{self.path}/segments/{s}/bucket={b}" for s, b in places))

    # changes

    def upsert(self, rows: DataFrame, order: Sequence[str] = ()) -> int:
        """Adds rows, or replaces those of the same doc_id; the version then reached.

        Of rows with one doc_id, that with the greatest values of ``order`` counts, then the greatest
        row. A null doc_id fails the write. Columns the table has not are left out. No rows, no new version.
        """
        schema = T.StructType.fromJson(self.manifest()["schema"])
        row = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        best = F.max(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), row.alias("row"))).alias("_best")
        repeated = rows.where(F.col(KEY).isNotNull()).groupBy(KEY).count().where("count > 1").select(KEY)  # ids alone travel
        picked = rows.select(row.alias("_row")).select("_row.*")
        if not repeated.isEmpty():
            many = rows.join(repeated, KEY, "left_semi").groupBy(KEY).agg(best).select("_best.row.*")
            picked = rows.join(repeated, KEY, "left_anti").select(row.alias("_row")).select("_row.*").unionByName(many)
        return self._append(picked.withColumn("_gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> int:
        """Takes out the documents of ``ids`` (doc_id); ids that the table has not do no harm."""
        schema = T.StructType.fromJson(self.manifest()["schema"])
        gone = [F.col(KEY).cast(schema[KEY].dataType) if f.name == KEY else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        return self._append(ids.where(F.col(KEY).isNotNull()).select(KEY).distinct().select(*gone).withColumn("_gone", F.lit(True)))

    def _write(self, rows: DataFrame, m: dict[str, Any]) -> tuple[str, list[str]]:
        """A segment of the rows and the buckets in it."""
        segment = uuid.uuid4().hex
        checked = F.when(F.col(KEY).isNull(), F.raise_error(F.lit("a document without doc_id"))).otherwise(_bucket(m))
        placed = rows.withColumn("bucket", checked).repartition("bucket").sortWithinPartitions("bucket", KEY)
        placed.write.partitionBy("bucket").parquet(f"{self.path}/segments/{segment}")
        return segment, sorted(n.removeprefix("bucket=") for n in self.folder.names(f"segments/{segment}") if n.startswith("bucket="))

    def _append(self, rows: DataFrame) -> int:
        segment, held = self._write(rows, self.manifest())
        if not held:
            return self.version()
        return self._advance(lambda m: m | {"deltas": [*m["deltas"], [segment, held]]})

    def compact(self) -> int:
        """Merges all deltas into the bases of their buckets; the rows stay the same, and so do all other buckets."""
        m = self.manifest()
        merged = {s for s, _ in m["deltas"]}
        dirty = {b for _, held in m["deltas"] for b in held}
        if not dirty:
            return m["number"]
        segment, held = self._write(self._rows(m, dirty).withColumn("_gone", F.lit(False)), m)

        def change(now: dict[str, Any]) -> dict[str, Any]:
            if not merged <= {s for s, _ in now["deltas"]}:
                raise TableMoved(self.path)
            base = {b: s for b, s in now["base"].items() if b not in dirty} | dict.fromkeys(held, segment)
            return now | {"base": base, "deltas": [d for d in now["deltas"] if d[0] not in merged]}

        return self._advance(change)

    def expire(self) -> list[str]:
        """Ends all snapshots before the newest and removes the segments that only they name."""
        newest = self._advance(lambda m: m | {"oldest": m["number"] + 1})
        kept = _named(self.log.record(newest))
        old = set().union(*(_named(self.log.record(i)) for i in range(newest))) - kept
        removed = [s for s in sorted(old) if self.folder.fs.get_file_info(self.folder.path(f"segments/{s}")).type == arrow_fs.FileType.Directory]
        for s in removed:
            self.folder.fs.delete_dir(self.folder.path(f"segments/{s}"))
        return removed


def _bucket(m: dict[str, Any]) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(m["buckets"])).cast("int")


def _named(m: dict[str, Any]) -> set[str]:
    return {*m["base"].values(), *(s for s, _ in m["deltas"])}


#: What the index keeps of a document besides its own columns.
COUNTED = [T.StructField("vec", T.ArrayType(T.IntegerType())), T.StructField("norm", T.LongType())]


def create_index(spark: SparkSession, path: str, docs: T.StructType, buckets: int = BUCKETS) -> DocumentTable:
    """A table for documents (doc_id, text, ...) with their token counts and norm."""
    return DocumentTable.create(spark, path, T.StructType([*docs.fields, *COUNTED]), buckets)


def index_documents(table: DocumentTable, docs: DataFrame, order: Sequence[str] = ()) -> int:
    """Upserts documents into an index; only these are counted."""
    counted = docs.withColumn("vec", vectors.counts(F.col("text")))
    return table.upsert(counted.withColumn("norm", vectors.square(F.col("vec"))), order)
