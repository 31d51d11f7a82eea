"""Permission decisions, against hand-made cases and brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from permitlake.errors import UnknownPurpose
from permitlake.functions import decide
from permitlake.schemas import LEDGER, Purpose, aware
from pyspark.sql import functions as F

NOW = datetime(2026, 8, 4, tzinfo=timezone.utc)
DAY = timedelta(days=1)


def row(subject, purposes=("direct_care",), scope=(), start=-10, end=None, revoked=None, version=1):
    at = lambda d: None if d is None else NOW + d * DAY
    return (subject, list(purposes), list(scope), at(start), at(end), at(revoked), version)


def allowed(spark, rows, purpose=Purpose.DIRECT_CARE, when=NOW, scope=None):
    return {r[0] for r in decide.consented(spark.createDataFrame(rows, LEDGER), purpose, F.lit(when), scope).collect()}


def test_branches(spark):
    rows = [row("active"), row("expired", end=-1), row("revoked", revoked=-1), row("future", start=1), row("other", purposes=["research"]), row("scoped", scope=["letter"])]
    assert allowed(spark, rows) == {"active", "scoped"}
    assert allowed(spark, rows, scope="letter") == {"active", "scoped"}
    assert allowed(spark, rows, scope="note") == {"active"}
    assert allowed(spark, rows, Purpose.RESEARCH) == {"other"}
    assert allowed(spark, []) == set()


def test_half_open_windows(spark):
    rows = [row("starts", start=0), row("ends", end=0), row("revoked", revoked=0)]
    assert allowed(spark, rows) == {"starts"}
    assert allowed(spark, rows, when=NOW - timedelta(microseconds=1)) == {"ends", "revoked"}


def test_only_the_latest_version_counts(spark):
    lower = [row("a", version=2, revoked=-1), row("a", version=1)]
    same = [row("b", version=2, revoked=-1), row("b", version=2)]
    dropped = [row("c", version=1), row("c", version=2, purposes=["research"])]
    assert allowed(spark, lower + same + dropped) == {"b"}


def test_random_ledgers(spark):
    rng = random.Random(7)
    maybe = lambda v: v if rng.random() < 0.5 else None
    every = [p.value for p in Purpose]
    rows = [
        row(f"s{rng.randrange(60)}", rng.sample(every, rng.randint(1, 3)), rng.sample(["x", "y"], rng.randint(0, 2)), rng.randint(-9, 3), maybe(rng.randint(-3, 5)), maybe(rng.randint(-3, 5)), rng.randint(1, 3))
        for _ in range(400)
    ]
    for purpose in Purpose:
        for scope in (None, "x"):
            want = set()
            for s in {r[0] for r in rows}:
                own = [r for r in rows if r[0] == s]
                top = max(r[6] for r in own)
                if any(r[6] == top and purpose.value in r[1] and (not r[2] or scope is None or scope in r[2]) and r[3] <= NOW and (r[4] is None or NOW < r[4]) and (r[5] is None or NOW < r[5]) for r in own):
                    want.add(s)
            assert allowed(spark, rows, purpose, scope=scope) == want


def test_vocabulary_and_instants():
    assert Purpose.parse("research") is Purpose.RESEARCH and Purpose.parse(Purpose.OUTREACH) is Purpose.OUTREACH
    with pytest.raises(UnknownPurpose):
        Purpose.parse("marketing")
    with pytest.raises(ValueError):
        aware(datetime(2026, 1, 1))


def test_faults(spark):
    rows = [row("ok"), row("none", purposes=[]), row("odd", purposes=["marketing"]), row("back", start=0, end=-1), row(None)]
    found = {r["subject"]: r["fault"] for r in decide.faults(spark.createDataFrame(rows, LEDGER)).collect()}
    assert found == {"ok": None, "none": "no purpose", "odd": "unknown purpose", "back": "inverted window", None: "no subject"}


def test_partition_sums_up(spark):
    people = spark.createDataFrame([("a",), ("b",), ("b",)], "subject string")
    ledger = spark.createDataFrame([row("a")], LEDGER)
    ok = decide.consented(ledger, Purpose.DIRECT_CARE, F.lit(NOW))
    assert {tuple(r) for r in decide.partition(people, ok).collect()} == {("a", True), ("b", False)}
    assert [r[0] for r in decide.hidden(people, ok).collect()] == ["b"]
