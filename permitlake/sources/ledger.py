"""The append-only permission ledger and decision log.

Rows are appended through the data source ``permit_ledger`` (``sink``): a batch is
sealed by one record of a Merkle history tree (``history``), and readers take
sealed batches only, so a write that fails at any step leaves a ledger that reads,
verifies and takes appends as before. Of two writers that have read the same state
one is refused and can append again. ``verify`` computes all digests anew, in
Spark; ``prove`` and ``extends`` give proofs to whoever keeps a root outside.
Nothing offers update or delete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitlake.errors import LedgerUnavailable
from permitlake.functions import decide
from permitlake.schemas import DECISIONS, LEDGER, Purpose, aware
from permitlake.sources.history import LOG, RECORD, Folder, History, consistent, faults, folded, included
from permitlake.sources.sink import NAME, LedgerSource

def _content(rows: DataFrame) -> Column:
    """A digest of a set of rows that doesn't depend on their order: sums of two row hashes."""
    cells = [F.col(c).cast("string") for c in rows.columns if c != "batch"]
    one = F.xxhash64(*cells).cast("decimal(38,0)")
    two = F.xxhash64(F.lit("second"), *cells).cast("decimal(38,0)")
    return F.concat_ws(":", F.count("*"), F.coalesce(F.sum(one), F.lit(0)), F.coalesce(F.sum(two), F.lit(0)))


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.closed = spark, path.rstrip("/"), False
        self._next: int | None = None

    # reading

    def _guard(self) -> None:
        if self.closed:
            raise LedgerUnavailable("the ledger is closed")

    def _read(self, name: str, schema: T.StructType) -> DataFrame | None:
        self._guard()
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise LedgerUnavailable(str(error)) from error

    def _sealed(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of the files that records name, with their batch."""
        self._guard()
        files = self._records(name).select(F.col("number").alias("batch"), F.explode("files").alias("f")).select("batch", F.col("f.name").alias("_file"))
        rows = self._read(name, schema)
        if rows is None:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
        return rows.withColumn("_file", F.col("_metadata.file_name")).join(files, "_file").drop("_file")

    def _records(self, name: str = "rows") -> DataFrame:
        self._guard()
        try:
            return self.spark.read.schema(RECORD).json(f"{self.path}/{name}/{LOG}/*.json")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], RECORD)
            raise LedgerUnavailable(str(error)) from error

    def rows(self) -> DataFrame:
        """All rows ever appended, with their batch."""
        return self._sealed("rows", LEDGER)

    def manifest(self) -> DataFrame:
        """A row per batch: its number, rows, own digest and the log's root after it."""
        return self._records().select(F.col("number").alias("batch"), "rows", F.col("leaf").alias("content"), F.col("root").alias("digest"))

    def decisions(self) -> DataFrame:
        return self._sealed("decisions", DECISIONS).drop("batch")

    def latest(self) -> DataFrame:
        return decide.latest(self.rows())

    def versions(self) -> DataFrame:
        return decide.versions(self.rows())

    def stamp(self, candidates: DataFrame | None = None) -> str:
        """A digest of every subject's version, and of the candidate set if given."""
        parts = [self.versions().agg(_content(self.versions())).first()[0]]
        if candidates is not None:
            parts.append(candidates.agg(_content(candidates)).first()[0])
        return hashlib.sha256("|".join(parts).encode()).hexdigest()

    def consented(self, purpose: Purpose | str, when: datetime, scope: str | None = None) -> DataFrame:
        return decide.consented(self.rows(), Purpose.parse(purpose), F.lit(aware(when)), scope)

    # appending

    def _append(self, name: str, rows: DataFrame, expected: int | None = None) -> None:
        self._guard()
        self.spark.dataSource.register(LedgerSource)
        write = rows.write.format(NAME).mode("append").option("path", f"{self.path}/{name}")
        try:
            (write if expected is None else write.option("expected", expected)).save()
        except Exception as error:
            if "another writer has taken" in str(error):
                raise LedgerUnavailable(f"another writer has taken batch {expected}; append again") from error
            raise

    def append(self, rows: DataFrame) -> int:
        """Appends valid rows as one batch; one fault in them refuses the batch."""
        self._guard()
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER.fields))
        rows = rows.withColumn("purposes", F.array_sort(F.array_distinct("purposes"))).withColumn("scope", F.coalesce(F.array_sort(F.array_distinct("scope")), F.array().cast("array<string>")))
        fault = decide.faults(rows).where("fault is not null").select("subject", "fault").limit(1).collect()
        if fault:
            raise ValueError(f"permission of {fault[0]['subject']}: {fault[0]['fault']}")
        number = self.history().size() if self._next is None else self._next
        self._next = None  # read anew, should this append fail
        self._append("rows", rows, number)
        self._next = number + 1
        return number

    def record(self, subject: str, purposes: Sequence[Purpose | str], valid_from: datetime, valid_until: datetime | None = None, revoked_at: datetime | None = None, scope: Sequence[str] = (), version: int = 1) -> int:
        row = Row(subject, [Purpose.parse(p).value for p in purposes], list(scope), aware(valid_from), valid_until and aware(valid_until), revoked_at and aware(revoked_at), version)
        return self.append(self.spark.createDataFrame([row], LEDGER))

    def revoke_all(self, subjects: DataFrame, at: datetime | None = None) -> None:
        """Appends, per subject, its latest rows one version up and revoked at the instant.

        An earlier revocation stays the earlier. A subject without a row gets one
        that is never active.
        """
        when = F.lit(aware(at or datetime.now(timezone.utc)))
        names = subjects.select("subject").distinct()
        old = self.latest().join(names, "subject", "left_semi")
        revoked = old.withColumn("revoked_at", F.least("revoked_at", when)).withColumn("version", F.col("version") + 1)
        new = names.join(self.versions(), "subject", "left_anti").select(
            "subject", F.array(F.lit(Purpose.DIRECT_CARE.value)).alias("purposes"), F.array().cast("array<string>").alias("scope"), when.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), when.alias("revoked_at"), F.lit(1).alias("version")
        )
        self.append(revoked.drop("batch").unionByName(new))

    def revoke(self, subject: str, at: datetime | None = None) -> int:
        """Revokes one subject; its new version."""
        self.revoke_all(self.spark.createDataFrame([(subject,)], "subject string"), at)
        return self.versions().where(F.col("subject") == subject).first()["version"]

    def log_decisions(self, decisions: DataFrame) -> None:
        self._append("decisions", decisions.select(*DECISIONS.names))

    def log_decision(self, subject: str, purpose: Purpose | str, version: int, allowed: bool) -> None:
        row = Row(datetime.now(timezone.utc), subject, Purpose.parse(purpose).value, version, allowed)
        self.log_decisions(self.spark.createDataFrame([row], DECISIONS))

    # integrity

    def history(self) -> History:
        return History(Folder(f"{self.path}/rows"))

    def verify(self) -> bool:
        """Every batch is as it was appended and in its place, and none is missing before the last."""
        records, where = self._records(), f"{self.path}/rows"
        if records.isEmpty():
            return True
        try:
            stored = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(where).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
        except AnalysisException:
            return False
        return not any(faults(records, stored).first())

    def root(self) -> tuple[int, str]:
        """The number of batches and the root over them, to be kept elsewhere."""
        head = self.history().head()
        return (head["number"] + 1, head["root"]) if head else (0, folded([]))

    def prove(self, batch: int) -> bool:
        """A batch belongs to the log, by a proof of O(log n) hashes."""
        size, root = self.root()
        history = self.history()
        return batch < size and included(history.record(batch)["leaf"], batch, size, history.inclusion(batch, size), root)

    def extends(self, size: int, root: str) -> bool:
        """The log is a continuation of one that had this size and root."""
        now, current = self.root()
        if size == 0 or size > now:
            return size == 0 and root == folded([])
        return consistent(size, root, now, current, self.history().consistency(size, now))

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
