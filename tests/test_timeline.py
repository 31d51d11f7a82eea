"""The sweep beside plain decisions at many instants."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from permitlake.functions import decide
from permitlake.operators import timeline
from permitlake.schemas import LEDGER, Purpose
from pyspark.sql import functions as F

NOW = datetime(2026, 8, 4, tzinfo=timezone.utc)


def at(day):
    return None if day is None else NOW + timedelta(days=day)


def made(seed, hot=0):
    """Random permissions: overlapping, touching, nested, endless, inverted, repeated; several versions.
    One subject holds ``hot`` rows of its own."""
    r = random.Random(seed)
    rows = []
    for i in range(150 + hot):
        subject = "hot" if i >= 150 else f"s{r.randrange(40)}"
        start = r.choice([r.randrange(60), 10, 20])
        end = r.choice([None, start + r.randrange(1, 30), start + 10, start + 10, start, start - 3] if i < 150 else [start + r.randrange(1, 4)])
        revoked = r.choice([None, None, start + r.randrange(-5, 20)])
        purposes = r.sample([p.value for p in Purpose], r.randrange(1, 4)) + (["unheard-of"] if r.random() < 0.1 else [])
        rows.append((subject, purposes, [], at(start), at(end), at(revoked), 1 if i >= 150 else r.choice([1, 2, 2])))
    return rows + rows[:5] + [(None, ["research"], [], at(1), None, None, 1), ("nobody", ["research"], [], None, None, None, 1), ("blank", None, [], at(1), None, None, 1)]


def plain(rows, when):
    """Counts per purpose by the rules themselves."""
    top: dict = {}
    for s, *_, v in rows:
        top[s] = max(v, top.get(s, v))
    seen = {p.value: set() for p in Purpose}
    for s, purposes, _, start, end, revoked, v in rows:
        if s is not None and v == top[s] and start is not None and start <= when and (end is None or when < end) and (revoked is None or when < revoked):
            for p in purposes or []:
                if p in seen:
                    seen[p].add(s)
    return {p: len(s) for p, s in seen.items()}


@pytest.mark.parametrize("seed, hot", [(1, 0), (2, 0), (3, 400)])
def test_counts_at_many_instants(spark, seed, hot):
    """Whole days, where intervals begin and end, and a microsecond to either side; repeated and null instants."""
    rows = made(seed, hot)
    moments = [NOW + timedelta(days=d) + timedelta(microseconds=m) for d in range(-10, 100) for m in (-1, 0, 1)]
    asked = spark.createDataFrame([(m,) for m in [*moments, *moments[:9], None]], "at timestamp")
    got = timeline.counts_at(timeline.changes(timeline.intervals(spark.createDataFrame(rows, LEDGER))), asked).collect()
    assert len(got) == len(moments) * len(Purpose)
    found = {(r["purpose"], r["at"].replace(tzinfo=timezone.utc)): r["permitted"] for r in got}
    for m in moments:
        want = plain(rows, m)
        assert {p: found[p, m] for p in want} == want, m


def test_a_subject_cut_by_ranges(spark):
    """More ranges than subjects: what earlier ranges reach is handed over, and only to cut subjects."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = [("hot", ["research"], [], at(0), at(1_000), None, 1)] + [("hot", ["research"], [], at(d), at(d + 1), None, 1) for d in range(1, 500)]
        changed = timeline.changes(timeline.intervals(spark.createDataFrame(rows, LEDGER))).where("delta != 0").orderBy("at").collect()
        assert [(r["at"].replace(tzinfo=timezone.utc), r["delta"]) for r in changed] == [(at(0), 1), (at(1_000), -1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_permission(spark):
    none = spark.createDataFrame([], LEDGER)
    asked = spark.createDataFrame([(NOW,)], "at timestamp")
    got = timeline.counts_at(timeline.changes(timeline.intervals(none)), asked).collect()
    assert {(r["purpose"], r["permitted"]) for r in got} == {(p.value, 0) for p in Purpose}
    assert timeline.Timeline.make(spark, none).permitted(Purpose.RESEARCH, NOW) == 0


def test_lookup_reads_one_range(spark):
    rows = made(4, 200)
    ledger = spark.createDataFrame(rows, LEDGER)
    kept = timeline.Timeline.make(spark, ledger)
    for day in (-5, 0, 7, 10, 33, 59, 90):
        when = NOW + timedelta(days=day)
        for p in (Purpose.RESEARCH, Purpose.OUTREACH):
            assert kept.permitted(p, when) == plain(rows, when)[p.value] == decide.consented(ledger, p, F.lit(when)).where("subject IS NOT NULL").count()
    assert sum(len(v) for v in kept.directory.values()) > len(Purpose) or len({p for v in kept.directory.values() for _, p in v}) > 1
    read = kept.steps(Purpose.RESEARCH, NOW + timedelta(days=33)).select("_part").distinct().collect()
    assert len(read) == 1
    plan = kept.steps(Purpose.RESEARCH, NOW + timedelta(days=33))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "LessThanOrEqual(at" in plan
