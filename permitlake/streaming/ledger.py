"""The ledger as a stream: a row whenever a subject lights up or goes dark for a purpose.

State is kept per slot, a few hundred or thousand subjects by the hash of their
names: for each of them the highest version, the union of its rows' windows and the
last answer. A call of Spark's Python state API costs about a millisecond whatever
it carries, so a batch costs calls by slots, not by subjects; a slot without rows and
without a boundary due is not read. Windows begin and end by timers: each slot has
one, at the next instant at which an answer in it can change. The stream's clock is
the rows' time of arrival in the log (``arrived``), so a row that arrives long
after its window began is late for its window, never for the stream: it counts
from its arrival on. Rows of one batch are taken in the order of arrival, and the
highest version decides, whatever that order is. The number of slots belongs to a
checkpoint: restart a stream with the number that it began with.

Needs Spark's RocksDB state store (``start`` sets it) and, on the executors, the
``protobuf`` package that Spark's Python state client uses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from permitlake.functions import decide
from permitlake.schemas import LEDGER, Purpose

SWITCH = "subject string, n long, at timestamp, allowed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = (1 << 63) - 1
SLOTS = 1_024
SLOT_SUBJECTS = 2_000  #: subjects of one slot, about, where they are counted first
TASK_SLOTS = 32
ARRIVED = T.StructType([*LEDGER.fields, T.StructField("arrived", T.TimestampType())])


def stream_rows(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Ledger rows as they are appended under ``path``; a column ``arrived``, where the files have it."""
    return spark.readStream.schema(ARRIVED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def versions(rows: DataFrame) -> DataFrame:
    """A running aggregate: each subject's highest version."""
    return rows.groupBy("subject").agg(F.max("version").alias("version"), F.count("*").alias("rows"))


def united(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same instants in windows that neither meet nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(w for w in windows if w[0] < w[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Subject:
    """A subject's answer through time, in milliseconds; ``changes`` has what is new of it."""

    def __init__(self, version: int = -1, seen: int = -NEVER, n: int = 0, allowed: bool = False, windows: list[tuple[int, int]] | None = None) -> None:
        self.version, self.seen, self.n, self.allowed, self.windows = version, seen, n, allowed, windows or []
        self.changes: list[tuple[int, int, bool]] = []

    def _look(self, at: int) -> None:
        now = any(a <= at < b for a, b in self.windows)
        if now != self.allowed:
            self.n, self.allowed = self.n + 1, now
            self.changes.append((self.n, at, now))

    def advance(self, to: int) -> None:
        """Lets time pass."""
        for at in sorted(t for w in self.windows for t in w if self.seen < t <= to):
            self._look(at)
        self.seen = max(self.seen, to)

    def take(self, arrived: int, version: int, granted: bool, window: tuple[int, int]) -> None:
        """A row of the ledger, at its arrival."""
        self.advance(arrived)
        if version < self.version:
            return
        if version > self.version:
            self.version, self.windows = version, []
        if granted:
            self.windows = united([*self.windows, window])
        self._look(self.seen)

    def due(self) -> int | None:
        return min((t for w in self.windows for t in w if self.seen < t < NEVER), default=None)


class Switches(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("slot", "due long, subject array<string>, version array<int>, seen array<long>, n array<long>, allowed array<boolean>, windows array<int>, begins array<long>, ends array<long>")

    def _load(self) -> tuple[dict[str, Subject], int | None]:
        kept = self.kept.get()
        if kept is None:
            return {}, None
        due, names, version, seen, n, allowed, sizes, begins, ends = kept
        bounds, at, slot = list(zip(begins, ends, strict=True)), 0, {}
        for i, name in enumerate(names):
            slot[name] = Subject(version[i], seen[i], n[i], allowed[i], bounds[at : at + sizes[i]])
            at += sizes[i]
        return slot, due

    def _store(self, slot: dict[str, Subject], timer: int | None) -> Iterator[pd.DataFrame]:
        due = min((t for one in slot.values() if (t := one.due()) is not None), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        every = list(slot.values())
        bounds = [w for one in every for w in one.windows]
        state = ([one.version for one in every], [one.seen for one in every], [one.n for one in every], [one.allowed for one in every], [len(one.windows) for one in every])
        self.kept.update((due, list(slot), *state, [a for a, _ in bounds], [b for _, b in bounds]))
        changes = [(name, *c) for name, one in slot.items() for c in one.changes]
        if changes:
            subject, n, at, allowed = zip(*changes, strict=True)
            yield pd.DataFrame({"subject": subject, "n": n, "at": pd.to_datetime(list(at), unit="ms"), "allowed": allowed})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        slot, timer = self._load()
        every = pd.concat(list(rows)).sort_values(["clock", "version"], kind="stable")
        for name, clock, version, granted, begins, ends in zip(*(every[c].tolist() for c in ("subject", "clock", "version", "granted", "begins", "ends")), strict=True):
            if (one := slot.get(name)) is None:
                one = slot[name] = Subject()
            one.take(clock, version, granted, (begins, ends))
        yield from self._store(slot, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        slot, timer = self._load()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(fired, timerValues.getCurrentWatermarkInMs())  # later boundaries may be due too
        for one in slot.values():
            if (due := one.due()) is not None and due <= now:
                one.advance(now)
        yield from self._store(slot, None if timer == fired else timer)

    def close(self) -> None:
        pass


def switches(rows: DataFrame, purpose: Purpose, scope: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Rows (subject, n, at, allowed): the n-th change of a subject's answer. ``rows`` has the ledger's columns and arrived."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    slim = rows.withWatermark("arrived", "0 seconds").select(
        F.col("subject").cast("string").alias("subject"), "arrived", F.col("version").cast("int").alias("version"), ms("arrived").alias("clock"),
        F.coalesce(decide.covers(purpose.value, scope), F.lit(False)).alias("granted"), F.coalesce(ms("valid_from"), F.lit(NEVER)).alias("begins"), F.coalesce(F.least(ms("valid_until"), ms("revoked_at")), F.lit(NEVER)).alias("ends"),
    )
    placed = slim.withColumn("slot", F.pmod(F.xxhash64("subject"), F.lit(slots)).cast("int"))
    return placed.groupBy("slot").transformWithStateInPandas(statefulProcessor=Switches(), outputStructType=SWITCH, outputMode="Append", timeMode="EventTime")


def start(changes: DataFrame, path: str, checkpoint: str, tasks: int | None = None) -> StreamingQuery:
    """Appends the changes to Parquet files under ``path`` until the input at hand is read.

    ``tasks`` is the number of the state's partitions (else Spark's setting); a checkpoint keeps its first.
    """
    spark = changes.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE} | ({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return changes.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def answers(changes: DataFrame) -> DataFrame:
    """Each subject's last answer (subject, allowed); subjects that never lit up have no row."""
    return changes.groupBy("subject").agg(F.max_by("allowed", "n").alias("allowed"))
