"""The table of documents: upserts, deletes, snapshots, compaction, failures and races."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from permitlake.sources import segments
from permitlake.sources.segments import DocumentTable, TableMoved, create_index, index_documents
from pyspark.sql import types as T

SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in ("doc_id", "subject", "title")), T.StructField("n", T.LongType())])


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(df):
    got = [tuple(r) for r in df.select(*SCHEMA.names).collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return DocumentTable.create(spark, str(tmp_path / "docs"), SCHEMA, 8)


def test_like_a_dictionary(spark, table):
    """Random upserts, deletes and compactions; every snapshot stays readable as it was."""
    r, now, then = random.Random(5), {}, {0: {}}
    for step in range(6):
        batch = {f"d{r.randrange(40)}": (f"s{r.randrange(5)}", r.choice([None, "", "x"]), step) for _ in range(12)}
        table.upsert(rows(spark, *((k, *v) for k, v in batch.items())))
        now |= batch
        then[table.version()] = dict(now)
        gone = r.sample(sorted(now), 3)
        table.delete(spark.createDataFrame([(g,) for g in [*gone, "unknown", None]], "doc_id string"))
        now = {k: v for k, v in now.items() if k not in gone}
        then[table.version()] = dict(now)
        if step % 3 == 2:
            table.compact()
            then[table.version()] = dict(now)
            assert not table.manifest()["deltas"]
    assert content(table.snapshot()) == now
    for version in random.Random(6).sample(sorted(then), 5):
        assert content(table.snapshot(version)) == then[version]


def test_empty_table_and_empty_writes(spark, table):
    assert content(table.snapshot()) == {}
    assert table.upsert(rows(spark)) == table.delete(spark.createDataFrame([], "doc_id string")) == table.compact() == 0
    table.upsert(rows(spark, ("a", "s", "t", 1)))
    table.delete(rows(spark, ("a", None, None, None)))
    table.compact()
    assert content(table.snapshot()) == {} and table.manifest()["base"] == {}


def test_repeated_rows_order_and_other_columns(spark, table):
    """The greatest by ``order`` counts, then the greatest row; columns that the table has not stay out, types are cast."""
    many = spark.createDataFrame([("a", "s", "old", 9, 1), ("a", "s", "new", 1, 2), ("b", "s", "x", 1, 7), ("b", "s", "y", 1, 7), ("b", "s", "y", 1, 7)], "doc_id string, subject string, title string, n int, row int")
    table.upsert(many, ["row"])
    assert content(table.snapshot()) == {"a": ("s", "new", 1), "b": ("s", "y", 1)}
    assert table.snapshot().columns == SCHEMA.names


def test_ten_documents_touch_their_buckets_only(spark, tmp_path):
    table = DocumentTable.create(spark, str(tmp_path / "docs"), SCHEMA, 64)
    table.upsert(rows(spark, *((f"d{i}", "hot", "t", i) for i in range(500))))
    table.compact()
    before, base = files(table.path), table.manifest()["base"]
    table.upsert(rows(spark, *((f"d{i}", "other", "new", -i) for i in range(10))))
    touched = set(table.manifest()["deltas"][0][1])
    assert len(touched) <= 10 and len(files(table.path) - before) <= 10
    table.compact()
    assert {b for b, s in table.manifest()["base"].items() if base[b] != s} == touched
    assert sum(r["n"] <= 0 for r in table.snapshot().collect()) == 10


def test_another_application_finds_all(spark, table):
    table.upsert(rows(spark, ("a", "s", "t", 1)))
    before = files(table.path)
    again = DocumentTable(spark.newSession(), table.path)
    assert content(again.snapshot()) == {"a": ("s", "t", 1)} and files(table.path) == before
    with pytest.raises(FileExistsError):
        DocumentTable.create(spark, table.path, SCHEMA)
    with pytest.raises(FileNotFoundError):
        DocumentTable(spark, table.path + "-none").snapshot()


def test_lookup_reads_the_buckets_of_its_ids(spark, table):
    table.upsert(rows(spark, *((f"d{i}", "s", "t", i) for i in range(200))))
    table.compact()
    table.upsert(rows(spark, ("d7", "s", "new", 0)))
    found = table.rows_of(["d7", "d8", "none"])
    assert content(found) == {"d7": ("s", "new", 0), "d8": ("s", "t", 8)}
    assert len({Path(f).parent.name for f in found.inputFiles()}) <= 3


def test_failed_writes_leave_nothing(spark, table, monkeypatch):
    """A row without id, and a crash before or at the manifest: the table is as it was and takes the next write."""
    table.upsert(rows(spark, ("a", "s", "t", 1)))
    with pytest.raises(Exception, match="without doc_id"):
        table.upsert(rows(spark, ("b", "s", "t", 1), (None, "s", "t", 1)))
    for method in ("_publish", "_write"):
        with monkeypatch.context() as m:
            m.setattr(DocumentTable, method, lambda *_: (_ for _ in ()).throw(OSError("lost")))
            for change in (lambda: table.upsert(rows(spark, ("c", "s", "t", 1))), table.compact):
                with pytest.raises(OSError, match="lost"):
                    change()
    assert table.version() == 1 and content(table.snapshot()) == {"a": ("s", "t", 1)}
    table.upsert(rows(spark, ("d", "s", "t", 1)))
    table.compact()
    assert set(content(table.snapshot())) == {"a", "d"}


def test_writers_that_meet(spark, table, monkeypatch):
    """A write that is overtaken goes on top; a compaction keeps what came meanwhile; the second of two gives way."""
    table.upsert(rows(spark, ("a", "s", "t", 1), ("b", "s", "t", 1)))
    other, plain = DocumentTable(spark, table.path), DocumentTable._write

    def overtaken(by):
        def write(self, *args):
            done = plain(self, *args)
            monkeypatch.setattr(DocumentTable, "_write", plain)
            by()
            return done

        monkeypatch.setattr(DocumentTable, "_write", write)

    overtaken(lambda: other.upsert(rows(spark, ("a", "s", "theirs", 2), ("c", "s", "theirs", 2))))
    table.upsert(rows(spark, ("a", "s", "mine", 3)))
    overtaken(lambda: other.upsert(rows(spark, ("b", "s", "late", 4))))
    table.compact()
    assert len(table.manifest()["deltas"]) == 1
    want = {"a": ("s", "mine", 3), "b": ("s", "late", 4), "c": ("s", "theirs", 2)}
    assert content(table.snapshot()) == want
    overtaken(other.compact)
    with pytest.raises(TableMoved):
        table.compact()
    assert content(table.snapshot()) == want


def test_expired_snapshots(spark, table):
    for i in range(3):
        table.upsert(rows(spark, ("a", "s", "t", i), (f"b{i}", "s", "t", i)))
    table.compact()
    want = content(table.snapshot())
    assert len(table.expire()) == 3 and table.expire() == []
    assert content(table.snapshot()) == want
    with pytest.raises(ValueError, match="no snapshot 2"):
        table.snapshot(2)


def test_index_counts_what_is_upserted(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one one two"), ("b", None), ("c", "")], "doc_id string, text string")
    index = create_index(spark, str(tmp_path / "index"), docs.schema, 4)
    index_documents(index, docs)
    index_documents(index, spark.createDataFrame([("c", "three")], docs.schema))
    assert {r["doc_id"]: (sum(r["vec"]), r["norm"]) for r in index.snapshot().collect()} == {"a": (3, 5), "b": (0, 0), "c": (1, 1)}
    assert segments.KEY in index.snapshot().columns
