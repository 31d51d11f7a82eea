"""The append-only ledger."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

import pytest
from permitlake.errors import LedgerUnavailable
from permitlake.schemas import LEDGER
from permitlake.sources.ledger import Ledger
from permitlake.sources.sink import LedgerSource
from pyspark.sql import functions as F
from worlds import CARE, DAY, NOW


@pytest.fixture
def ledger(spark, tmp_path):
    out = Ledger(spark, str(tmp_path / "ledger"))
    out.record("a", [CARE], NOW - 10 * DAY)
    return out


def who(ledger, when=NOW):
    return {r[0] for r in ledger.consented(CARE, when).collect()}


def test_revocation_is_an_append(ledger):
    before = ledger.rows().count()
    assert ledger.revoke("a", NOW) == 2
    assert ledger.rows().count() == before + 1
    assert who(ledger) == set() and who(ledger, NOW - DAY) == {"a"}
    assert not hasattr(ledger, "update") and not hasattr(ledger, "delete")


def test_second_revocation_keeps_the_earlier_instant(ledger):
    ledger.revoke("a", NOW - 2 * DAY)
    ledger.revoke("a", NOW)
    assert who(ledger, NOW - DAY) == set()  # a copied later instant would make it active again


def test_revoking_an_unknown_subject(ledger):
    assert ledger.revoke("stranger", NOW) == 1
    assert who(ledger) == {"a"} and who(ledger, NOW + DAY) == {"a"}


def test_faulty_rows_are_refused(ledger):
    before = ledger.rows().count()
    with pytest.raises(ValueError):
        ledger.record("x", [], NOW)
    with pytest.raises(ValueError):
        ledger.record("x", [CARE], NOW, valid_until=NOW - DAY)
    with pytest.raises(ValueError):
        ledger.record("x", [CARE], NOW.replace(tzinfo=None))
    assert ledger.rows().count() == before


def test_strays_are_not_read(ledger):
    """A file that no record names is no part of the ledger, wherever it comes from."""
    forged = ledger.rows().limit(1).withColumn("subject", F.lit("c")).drop("batch")
    forged.write.mode("append").parquet(f"{ledger.path}/rows")
    assert who(ledger) == {"a"} and ledger.verify()


def altered_log(path, change):
    record = Path(path, "rows", "_log", f"{1:020d}.json")
    data = json.loads(record.read_text())
    change(data)
    record.write_text(json.dumps(data))


@pytest.mark.parametrize(
    "change",
    [
        lambda path: next(Path(path, "rows").glob("*.parquet")).unlink(),
        lambda path: shutil.copyfile(*sorted(Path(path, "rows").glob("*.parquet"))[:2]),
        lambda path: Path(path, "rows", "_log", f"{1:020d}.json").unlink(),
        lambda path: altered_log(path, lambda r: r.update(rows=7)),
        lambda path: altered_log(path, lambda r: r["files"].clear()),
        lambda path: altered_log(path, lambda r: r["nodes"].__setitem__(1, "00" * 32)),
        lambda path: altered_log(path, lambda r: r["peaks"].__setitem__(0, "00" * 32)),
        lambda path: altered_log(path, lambda r: r.update(root="00" * 32)),
    ],
)
def test_verify_notices_changes(ledger, change):
    ledger.record("b", [CARE], NOW)
    ledger.record("c", [CARE], NOW)
    assert ledger.verify()
    change(ledger.path)
    assert not ledger.verify()


def test_proofs_to_an_outside_root(spark, ledger):
    size, root = ledger.root()
    for s in "bcd":
        ledger.record(s, [CARE], NOW)
    assert all(ledger.prove(i) for i in range(4)) and not ledger.prove(4)
    assert ledger.extends(size, root) and not ledger.extends(size, "00" * 32)
    size, root = ledger.root()
    Path(ledger.path, "rows", "_log", f"{3:020d}.json").unlink()  # cut short: only the kept root shows it
    assert ledger.verify() and not Ledger(spark, ledger.path).extends(size, root)


def test_failed_write_leaves_nothing(spark, ledger):
    """A task that fails, after another has written: the next append goes on as if nothing had been."""
    fail = F.udf(lambda s: 1 // (s != "bad"), "int")
    rows = spark.createDataFrame([(s,) for s in ("x", "y", "bad")], "subject string").repartition(3)
    valid = rows.select("subject", F.array(F.lit(CARE.value)).alias("purposes"), F.array().cast("array<string>").alias("scope"), F.lit(NOW).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit(None).cast("timestamp").alias("revoked_at"))
    with pytest.raises(Exception, match="ZeroDivision"):
        ledger._append("rows", valid.withColumn("version", fail("subject")), 1)
    assert ledger.record("b", [CARE], NOW - DAY) == 1
    assert Ledger(spark, ledger.path).record("c", [CARE], NOW - DAY) == 2
    assert ledger.verify() and who(ledger) == {"a", "b", "c"}


def test_stream_batches_are_taken_once(spark, ledger, tmp_path):
    """A streaming query into the ledger; its last batch replayed after its commit was lost."""
    spark.dataSource.register(LedgerSource)
    src, mark, path = str(tmp_path / "src"), tmp_path / "mark", f"{ledger.path}/rows"
    rows = lambda *s: ledger.rows().drop("batch").limit(1).crossJoin(spark.createDataFrame([(x,) for x in s], "s string")).withColumn("subject", F.col("s")).drop("s")

    def run():
        stream = spark.readStream.schema(LEDGER).parquet(src)
        stream.writeStream.format("permit_ledger").option("path", path).option("stream", "in").option("checkpointLocation", str(mark)).trigger(availableNow=True).start().awaitTermination()

    rows("s", "t").write.mode("append").parquet(src)
    run()
    rows("u").write.mode("append").parquet(src)
    run()
    assert who(ledger) == {"a", "s", "t", "u"}
    before = ledger.rows().count()
    for lost in ("1", ".1.crc"):  # the query doesn't know that its batch 1 was taken
        (mark / "commits" / lost).unlink()
    run()
    assert ledger.rows().count() == before and ledger.verify()


def test_reopened_ledger_goes_on(spark, ledger):
    again = Ledger(spark, ledger.path)
    again.record("b", [CARE], NOW - DAY)
    assert again.verify() and who(again) == {"a", "b"}
    assert [r["batch"] for r in again.manifest().orderBy("batch").collect()] == [0, 1]


def test_two_writers(spark, ledger):
    one, two = Ledger(spark, ledger.path), Ledger(spark, ledger.path)
    one.record("b", [CARE], NOW - DAY)
    two.record("c", [CARE], NOW - DAY)  # reads the state at its first append
    with pytest.raises(LedgerUnavailable):
        one.record("d", [CARE], NOW - DAY)
    one.record("d", [CARE], NOW - DAY)
    assert one.verify() and who(one) == {"a", "b", "c", "d"}


def test_closed_ledger_refuses(ledger):
    with ledger:
        pass
    with pytest.raises(LedgerUnavailable):
        ledger.rows()


def test_decision_log(ledger):
    ledger.log_decision("a", CARE, 1, True)
    ledger.log_decision("b", CARE, 0, False)
    assert {(r["subject"], r["allowed"]) for r in ledger.decisions().collect()} == {("a", True), ("b", False)}


def test_stamp_follows_versions(ledger):
    one = ledger.stamp()
    assert one == ledger.stamp()
    ledger.revoke("a", NOW)
    assert ledger.stamp() != one
