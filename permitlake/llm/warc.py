"""WARC archives with a two-level capture index.

Writing: of pages with equal payloads (of at least ``min_revisit`` bytes), the
one with the largest page_id becomes a response, the others revisits of it. A
record is a gzip member of its own, so that it can be read by its byte range.
Spark's text writer commits the files; its line separator is an empty gzip
member, which readers of concatenated members skip.

Index: captures sorted by reversed-host URL key (and page) are cut into
blocks of ``block_lines`` lines, each a gzip member of an index file. A file is
a shard, a range of keys; its blocks' first keys and byte ranges make the sparse
directory.

Lookup: a binary search over the shards' first keys (``max_shards`` at most)
sends each key to its shard, one in the shard's part of the directory finds its
block; shards that many keys ask for are dealt on by key. Only then the blocks
named are read by their byte ranges, each once, with a binary search for each of
its keys. Captures are then read by byte range, file by file.

Edge cases: a null html is an empty payload; a null or blank URL has the key
``-``; white space and control characters in URLs are percent-encoded; rows
that repeat a page are records of their own (all responses if theirs is the
largest page_id); a null page_id sorts below all others; an empty table gives
no archive and finds nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.llm.common import materialize, scratch_dir

#: Fixed value: the gzip member of no bytes.
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NONE = -(1 << 63)
DIRECTORY = "shard int, block int, first_key string, last_key string, lines int, path string, offset long, length long"
CAPTURE = "key string, path string, offset long, length long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


@dataclass(frozen=True)
class Params:
    min_revisit: int = 1000
    date: str = "1970-01-01T00:00:00Z"  #: of the records, as the table has no time
    block_lines: int = 1_000
    shard_lines: int = 50_000
    max_shards: int = 100_000
    asked_keys: int = 100_000  #: of a shard, above which they are dealt on


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip())


def url_key(url: str | None) -> str:
    """The reversed-host key: http://www.a.org:80/x?y#z becomes org,a,www)/x?y."""
    url = clean_url(url)
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").strip("."), parts.port
    except ValueError:
        return f"invalid){url}"
    port_text = f":{port}" if port not in (None, 80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){(parts.path or '/').lower()}{'?' + parts.query if parts.query else ''}"


def page_key(url: str | None, page_id: int | None) -> str:
    """URL key and page, the page so written that its text sorts like its number."""
    return f"{url_key(url)} {(NONE if page_id is None else page_id) - NONE:020d}"


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or with refers_to a revisit, as a gzip member."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean_url(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def write_archives(pages: DataFrame, path: str, p: Params = Params()) -> None:
    """Writes a record for every row (page_id, url, html) to gzipped WARC files under ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    same = rows.where(F.col("bytes") >= p.min_revisit).groupBy("digest", "bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(same, ["digest", "bytes"], "left")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            null = lambda x: None if pd.isna(x) else int(x)
            yield pd.DataFrame({"value": [record(null(i), u, h, d, null(r), p.date) for i, u, h, d, r in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["digest"], pdf["refers_to"], strict=True)]})

    packed = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to")).withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("page_id", "refers_to")})
    write_members(packed.mapInPandas(pack, "value binary"), path)


def write_members(values: DataFrame, path: str) -> None:
    """Writes gzip members (value) one after the other, a file for each partition."""
    # the writer copies the bytes as they are; the encoding is that of the separator
    values.select(F.col("value").cast("string")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, size) of the archive files; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", F.col("length").alias("size"))


def _open(path: str):  # noqa: ANN202
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return where.open_input_file(name)


def members(source, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:  # noqa: ANN001
    """(offset, length, content) of each gzip member but empty ones."""
    unpack, start, at, parts, data = zlib.decompressobj(31), 0, 0, [], b""
    while True:
        if not data:
            data = source.read(chunk)
            if not data:
                return
        parts.append(unpack.decompress(data))
        at += len(data) - len(unpack.unused_data)
        data = unpack.unused_data
        if unpack.eof:
            if content := b"".join(parts):
                yield start, at - start, content
            unpack, start, parts = zlib.decompressobj(31), at, []


def captures(listed: DataFrame) -> DataFrame:
    """Scans archive files (path, size) for their captures."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                with _open(path) as f:
                    for offset, length, content in members(f):
                        head, _, _ = parse(content)
                        rows.append((page_key(head["WARC-Target-URI"], _number(head["WARC-Record-ID"])), path, offset, length, head["WARC-Type"]))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["key", "path", "offset", "length", "record_type"])
                            rows = []
                yield pd.DataFrame(rows, columns=["key", "path", "offset", "length", "record_type"])

    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "path").mapInPandas(scan, CAPTURE)


def build_index(found: DataFrame, p: Params = Params()) -> DataFrame:
    """Writes the index files; their directory, a row for every block in the order of the keys."""
    spark = found.sparkSession
    found = materialize(found, "warc-captures")
    shards = min(p.max_shards, max(1, -(-found.count() // p.shard_lines)))
    line = F.concat_ws(" ", "key", "path", "offset", "length", "record_type").alias("line")
    dealt = found.repartitionByRange(shards, "key", "path", "offset").sortWithinPartitions("key", "path", "offset").select(line)

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []

        def block(lines: list[str]) -> bytes:
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            return pack.compress("\n".join(lines).encode()) + pack.flush()

        for pdf in batches:
            held += pdf["line"].tolist()
            whole = len(held) - len(held) % p.block_lines
            yield pd.DataFrame({"value": [block(held[a : a + p.block_lines]) for a in range(0, whole, p.block_lines)]})
            held = held[whole:]
        if held:
            yield pd.DataFrame({"value": [block(held)]})

    path = scratch_dir(spark, "warc-index")
    write_members(dealt.mapInPandas(compress, "value binary"), path)
    return materialize(directory(files(spark, path)), "warc-directory")


def directory(listed: DataFrame) -> DataFrame:
    """Scans index files (path, size) for the first keys and byte ranges of their blocks."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                with _open(path) as f:
                    for n, (offset, length, content) in enumerate(members(f)):
                        keys = [x.rsplit(" ", 4)[0] for x in content.decode().split("\n")]
                        rows.append((int(re.search(r"part-(\d+)", path)[1]), n, keys[0], keys[-1], len(keys), path, offset, length))
                yield pd.DataFrame(rows, columns=["shard", "block", "first_key", "last_key", "lines", "path", "offset", "length"])

    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "path").mapInPandas(scan, DIRECTORY)


def named_blocks(index: DataFrame, keys: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (key, path, offset, length): the blocks that may hold each of ``keys`` (key), by the directory alone."""
    spark = index.sparkSession
    bounds = [(r["first"], r["shard"]) for r in index.groupBy("shard").agg(F.min("first_key").alias("first")).orderBy("first", "shard").collect()]  # max_shards rows
    firsts, numbers = [b for b, _ in bounds], [int(s) for _, s in bounds]

    @F.pandas_udf("array<int>")
    def shards_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: numbers[max(0, bisect.bisect_left(firsts, k) - 1) : bisect.bisect_right(firsts, k)])

    def find(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        first, where = blocks["first_key"].tolist(), list(zip(blocks["path"], blocks["offset"], blocks["length"], strict=True))
        out: list[tuple] = []
        for key in asked["key"] if first else []:
            b = max(0, bisect.bisect_left(first, key) - 1)
            out += [(key, *where[i]) for i in range(b, bisect.bisect_right(first, key))]
        return pd.DataFrame(out, columns=["key", "path", "offset", "length"]).astype({"offset": "int64", "length": "int64"})

    asked = materialize(keys.select("key").where("key IS NOT NULL").distinct().withColumn("shard", F.explode(shards_of("key"))), "warc-asked")
    many = [(r["shard"], -(-r["count"] // p.asked_keys)) for r in asked.groupBy("shard").count().collect()]  # max_shards rows
    salts = F.broadcast(spark.createDataFrame(many, "shard int, salts int"))
    left = asked.join(salts, "shard").select("key", "shard", F.pmod(F.xxhash64("key"), "salts").cast("int").alias("salt"))
    right = index.select("shard", "block", "first_key", "path", "offset", "length").join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(find, "key string, path string, offset long, length long")


def lookup(index: DataFrame, keys: DataFrame, p: Params = Params()) -> DataFrame:
    """The captures whose key is one of ``keys`` (key; nulls find nothing); each asked once, all its captures found."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, f, lines, own = (None, -1), None, [], []
        for pdf in batches:
            out: list[tuple] = []
            for key, path, offset, length in zip(pdf["key"], pdf["path"], pdf["offset"], pdf["length"], strict=True):
                if (path, offset) != opened:
                    if path != opened[0]:
                        if f:
                            f.close()
                        f = _open(path)
                    f.seek(offset)
                    lines = [x.rsplit(" ", 4) for x in zlib.decompress(f.read(length), 31).decode().split("\n")]
                    opened, own = (path, offset), [x[0] for x in lines]
                for i in range(bisect.bisect_left(own, key), bisect.bisect_right(own, key)):
                    out.append((key, lines[i][1], int(lines[i][2]), int(lines[i][3]), lines[i][4]))
            yield pd.DataFrame(out, columns=["key", "path", "offset", "length", "record_type"]).astype({"offset": "int64", "length": "int64"})
        if f:
            f.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named_blocks(index, keys, p).repartition(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInPandas(read, CAPTURE)


def read_records(found: DataFrame) -> DataFrame:
    """Reads captures by byte range; a response's digest is computed anew from its payload."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, f = None, None
        for pdf in batches:
            rows = []
            for name, offset, length in zip(pdf["path"], pdf["offset"], pdf["length"], strict=True):
                if name != path:
                    if f:
                        f.close()
                    path, f = name, _open(name)
                f.seek(offset)
                head, http, payload = parse(zlib.decompress(f.read(length), 31))
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response":
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"damaged record at {offset} of {name}")
                rows.append((_number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], _number(head.get("WARC-Refers-To")), size, digest, payload if head["WARC-Type"] == "response" else None))
            out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if f:
            f.close()

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "path").sortWithinPartitions("path", "offset").mapInPandas(read, RECORD)


def archive(pages: DataFrame, p: Params = Params()) -> tuple[str, DataFrame]:
    """Writes the archives of ``pages`` to the shared folder; their path and index."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, path, p)
    return path, build_index(captures(files(pages.sparkSession, path)), p)


def page_keys(pages: DataFrame) -> DataFrame:
    """Rows (key) of the pages' index keys."""

    @F.pandas_udf("string")
    def key(url: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([page_key(u, None if i is None else int(i)) for u, i in zip(url, page, strict=True)])

    return pages.select(key("url", F.col("page_id").cast("string")).alias("key"))
