"""WARC archives: round trips, record types and the index."""

from __future__ import annotations

import gzip
import hashlib
import io
from pathlib import Path

import duckdb
from permitlake.llm import queries, warc
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def answers(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA)
    path, index = warc.archive(pages)
    return path, index, warc.read_records(warc.lookup(index, warc.page_keys(pages)))


def test_round_trip_and_revisits(spark):
    big = "é" * 600 + "\r\n\r\n<p>"
    rows = [(1, "http://www.a.org/x", big), (2, "https://b.org:443/y?q#f", big), (3, "http://a.org/z", "small"), (4, "http://a.org/z2", "small"), (5, None, None), (-7, "bad url \n with space", ""), (6, "http://[bad", "x\r\n\r\ny"), (None, "http://n.org/", "null id")]
    _, _, got = answers(spark, rows)
    by = {r["page_id"]: r for r in got.collect()}
    assert set(by) == {1, 2, 3, 4, 5, -7, 6, None}
    for i, _, html in rows:
        data = (html or "").encode()
        assert by[i]["payload_digest"] == hashlib.sha1(data).hexdigest() and by[i]["payload_bytes"] == len(data)
        assert by[i]["payload"] is None if i == 1 else bytes(by[i]["payload"]) == data
    assert (by[1]["record_type"], by[1]["refers_to"], by[2]["record_type"], by[2]["refers_to"]) == ("revisit", 2, "response", None)
    assert by[3]["record_type"] == by[4]["record_type"] == "response"


def test_archives_are_plain_gzip(spark):
    path, _, _ = answers(spark, [(i, f"http://h.org/{i}", "t" * i) for i in range(1, 6)])
    text = b"".join(gzip.open(f).read() for f in Path(path.removeprefix("file:")).glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == 5
    assert [c for f in Path(path.removeprefix("file:")).glob("part-*") for _, _, c in warc.members(io.BytesIO(f.read_bytes()), chunk=7)].__len__() == 5


def test_repeated_rows_and_empty_table(spark):
    _, _, got = answers(spark, [(1, "http://a.org/", "x")] * 3)
    assert [r["record_type"] for r in got.collect()] == ["response"] * 3
    assert answers(spark, [])[2].count() == 0


def test_two_level_lookup(spark):
    rows = [(f"org,h{i % 7})/{i:05d} {i:020d}", f"file:/f{i % 3}", i, 10, "response") for i in range(500)] + [("org,h0)/hot 1", "file:/f", i, 10, "response") for i in range(300)]
    index = warc.build_index(spark.createDataFrame(rows, warc.CAPTURE), warc.Params(block_lines=16, shard_lines=100))
    assert index.select("shard").distinct().count() > 2 and index.agg(F.max("lines")).first()[0] == 16
    assert index.where("first_key > last_key").count() == 0
    asked = spark.createDataFrame([(r[0],) for r in rows[::3]] + [("org,none)/",), ("a",), ("zz",), ("org,h0)/hot 1",)], "key string")
    got = sorted(tuple(r) for r in warc.lookup(index, asked).collect())
    keys = {r[0] for r in asked.collect()}
    assert got == sorted(r for r in rows if r[0] in keys)


def test_url_keys():
    assert warc.url_key("http://www.a.org:80/X?y#z") == "org,a,www)/x?y" and warc.url_key("a.org:8080") == "org,a:8080)/"
    assert warc.url_key(None) == warc.url_key(" ") == "-" and warc.url_key("http://[bad").startswith("invalid)")
    assert warc.page_key("a.org", -5) < warc.page_key("a.org", 3) < warc.page_key("a.org", 20)


def test_query_is_the_sql(spark, tmp_path):
    page = "p" * 2000
    spark.createDataFrame([(i, f"http://a.org/{i}", page if i % 3 else f"own {i}") for i in range(30)] + [(99, None, None)], SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rows = c.execute(queries.SQL["op2_warc"])
    columns = [x[0] for x in rows.description]
    assert sorted(map(repr, rows.fetchall())) == sorted(repr(tuple(r[x] for x in columns)) for r in queries.op2_warc(spark, str(tmp_path)).collect())


def test_lookup_reads_only_the_blocks_named(spark):
    rows = [(f"org,h)/{i:05d}", "file:/f", i, 10, "response") for i in range(2000)]
    index = warc.build_index(spark.createDataFrame(rows, warc.CAPTURE), warc.Params(block_lines=20, shard_lines=500))
    assert index.count() >= 100
    for asked, blocks in (("org,h)/01234", 1), ("org,h)/00000", 1), ("zz", 1), ("a", 0)):
        key = spark.createDataFrame([(asked,), (asked,), (None,)], "key string")
        assert warc.named_blocks(index, key).count() <= max(blocks, 1)
        assert [r["offset"] for r in warc.lookup(index, key).collect()] == [r[2] for r in rows if r[0] == asked]


def test_shards_that_many_keys_ask_for_are_dealt_on(spark):
    rows = [(f"org,h)/{i:05d}", "file:/f", i, 10, "response") for i in range(300)]
    index = warc.build_index(spark.createDataFrame(rows, warc.CAPTURE), warc.Params(block_lines=10))
    asked = spark.createDataFrame([(f"org,h)/{i:05d}{x}",) for i in range(300) for x in ("", "-none")], "key string")
    got = warc.lookup(index, asked, warc.Params(asked_keys=50)).collect()
    assert sorted(tuple(r) for r in got) == rows


def test_writer_copies_every_byte(spark, tmp_path):
    values = [bytes(range(256)), bytes([0xFF, 0xFE, 0xC3, 0x28, 0x0A, 0x0D]), b"\x80" * 9]
    warc.write_members(spark.createDataFrame([(bytearray(v),) for v in values], "value binary").coalesce(1), str(tmp_path / "m"))
    assert b"".join(f.read_bytes() for f in sorted((tmp_path / "m").glob("part-*"))) == b"".join(v + warc.EMPTY for v in values)


def test_extra_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x" * 2000), (2, "http://b.org/", "x" * 2000)], SCHEMA).withColumns({c: F.lit("y") for c in ("digest", "bytes", "kept", "key", "path", "shard", "value", "refers_to")})
    _, index = warc.archive(pages)
    got = warc.read_records(warc.lookup(index, warc.page_keys(pages))).select("page_id", "refers_to").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, None)]
