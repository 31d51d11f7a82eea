"""The ledger as a stream, beside decisions over the whole ledger and a plain simulation."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from permitlake.functions import decide
from permitlake.schemas import Purpose
from permitlake.streaming import ledger as stream
from pyspark.sql import functions as F

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)
CARE = Purpose.DIRECT_CARE


def ledger(seed, n, subjects):
    """Rows in the order of arrival: some begin long before they arrive, some later; versions in any order; one hot subject."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        arrived = START + i * HOUR
        begins = arrived + r.randint(-40, 40) * HOUR
        until = r.choice([None, begins + r.randint(1, 60) * HOUR])
        revoked = r.choice([None, None, begins + r.randint(-5, 60) * HOUR])
        who = "hot" if r.random() < 0.34 else f"s{r.randrange(subjects)}"
        out.append((who, [r.choice(["direct_care", "research"])], r.choice([[], [], ["en"]]), begins, until, revoked, r.randint(1, 4), arrived))
    return out


def at_every_hour(rows, who, end):
    """The answer at each hour, from the rows that have arrived by then."""
    out = []
    for h in range(end):
        now = START + h * HOUR
        own = [x for x in rows if x[0] == who and x[7] <= now]
        top = max((x[6] for x in own), default=None)
        out.append(any(x[6] == top and "direct_care" in x[1] and x[3] <= now and not (x[4] and x[4] <= now) and not (x[5] and x[5] <= now) for x in own))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_answers_through_time(seed):
    rows = ledger(seed, 60, 2)
    ms = lambda t: int(t.timestamp() * 1000)
    for who in ("hot", "s0", "s1"):
        one = stream.Subject()
        for x in (x for x in rows if x[0] == who):
            one.take(ms(x[7]), x[6], "direct_care" in x[1], (ms(x[3]), min((ms(t) for t in x[4:6] if t), default=stream.NEVER)))
        one.advance(ms(START + 150 * HOUR))
        want = at_every_hour(rows, who, 150)
        got = [next((a for _, t, a in reversed(one.changes) if t <= ms(START + h * HOUR)), False) for h in range(150)]
        assert got == want
        assert [n for n, _, _ in one.changes] == list(range(1, len(one.changes) + 1))
        assert all(a != b for (_, _, a), (_, _, b) in zip(one.changes, one.changes[1:], strict=False))


@pytest.mark.parametrize("windows", [[], [(1, 3), (3, 5)], [(5, 2)], [(1, 9), (2, 3)], [(4, 6), (1, 2)]])
def test_united(windows):
    one = stream.united(windows)
    inside = lambda ws, t: any(a <= t < b for a, b in ws)
    assert all(inside(one, t) == inside(windows, t) for t in range(10)) and one == sorted(one)


def test_stream_of_batches(spark, tmp_path):
    """Three batches, a restart between them, timers that fall due without rows: the last
    answers are those of the whole ledger at the clock, and no change is told twice."""
    rows = ledger(3, 90, 5)
    tick = ("", ["research"], [], START, None, None, 1, START + 200 * HOUR + timedelta(minutes=30))
    src, out, mark = (str(tmp_path / x) for x in ("rows", "changes", "mark"))

    def feed(part):
        spark.createDataFrame(part, stream.ARRIVED).coalesce(1).write.mode("append").parquet(src)
        stream.start(stream.switches(stream.stream_rows(spark, src, 1), CARE), out, mark).awaitTermination()

    feed(rows[:50])
    feed(rows[50:])
    feed([tick])
    changes = spark.read.schema(stream.SWITCH).parquet(out)
    every = spark.createDataFrame(rows, stream.ARRIVED)
    want = {r[0] for r in decide.consented(every, CARE, F.lit(START + 200 * HOUR + timedelta(minutes=30))).collect()}
    assert {r["subject"] for r in stream.answers(changes).where("allowed").collect()} == want
    told = {}
    for r in changes.orderBy("n").collect():
        told.setdefault(r["subject"], []).append((r["n"], r["allowed"]))
    for own in told.values():
        assert own == [(i + 1, i % 2 == 0) for i in range(len(own))]
    q = stream.versions(stream.stream_rows(spark, src)).writeStream.outputMode("complete").format("memory").queryName("versions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("versions").where("subject <> ''").select("subject", "version").collect()} == {tuple(r) for r in decide.versions(every).collect()}


def test_calls_by_slots(spark, tmp_path):
    """Many subjects share a slot's state: its rows and timers grow with the slots, and every answer stays its own subject's."""
    rows = ledger(5, 900, 400)
    tick = ("", ["research"], [], START, None, None, 1, START + 1_000 * HOUR + timedelta(minutes=30))
    src, out, mark = (str(tmp_path / x) for x in ("rows", "changes", "mark"))
    for part in (rows[:500], rows[500:], [tick]):
        spark.createDataFrame(part, stream.ARRIVED).coalesce(1).write.mode("append").parquet(src)
        query = stream.start(stream.switches(stream.stream_rows(spark, src), CARE, slots=8), out, mark, 2)
        query.awaitTermination()
        assert all(o["numRowsTotal"] <= 8 * 4 for p in query.recentProgress for o in p["stateOperators"])
        assert all(o["numShufflePartitions"] == 2 for p in query.recentProgress for o in p["stateOperators"])
    want = {r[0] for r in decide.consented(spark.createDataFrame(rows, stream.ARRIVED), CARE, F.lit(tick[7])).collect()}
    assert {r["subject"] for r in stream.answers(spark.read.schema(stream.SWITCH).parquet(out)).where("allowed").collect()} == want
    assert len(want) > 20 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
