"""An append-only log of batches as a Merkle history tree, kept in files.

A record names a batch's files with their SHA-256 digests. Its own digest is the
next leaf of a hash tree over all records (as in transparency logs: leaves and
inner nodes are hashed under different prefixes, a tree over n leaves splits at
the largest power of two below n). Each record also holds the subtrees that its
leaf completes and the peaks of the tree so far, so an append reads one record,
and a proof that a record belongs to the log (``inclusion``), or that an earlier
log is a beginning of this one (``consistency``), reads O(log n) of them.

A record appears whole or not at all: it is written under another name and then
linked to its number, which only one writer can do. Whoever keeps a root outside
can show any later change, removal or truncation.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = "struct<name:string,sha256:string,rows:bigint>"
RECORD = f"number long, rows long, files array<{FILE}>, leaf string, nodes array<string>, peaks array<string>, root string, streams map<string,bigint>"
LOG = "_log"


class LogMoved(Exception):
    """Another writer has appended since the caller read the log."""


class Folder:
    """Files under one path, on any file system that can rename without overwriting."""

    def __init__(self, path: str) -> None:
        path = re.sub("^file:/+", "/", path.rstrip("/"))
        self.fs, self.base = (arrow_fs.LocalFileSystem(), path) if path.startswith("/") else arrow_fs.FileSystem.from_uri(path)
        if self.fs.type_name not in ("local", "hdfs"):
            raise ValueError(f"{self.fs.type_name} cannot rename without overwriting; keep the log on another store")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read(self, name: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(self.path(name)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def output(self, name: str):  # noqa: ANN201
        self.fs.create_dir(os.path.dirname(self.path(name)), recursive=True)
        return self.fs.open_output_stream(self.path(name))

    def move(self, old: str, new: str) -> None:
        self.fs.move(self.path(old), self.path(new))

    def remove(self, name: str) -> None:
        try:
            self.fs.delete_file(self.path(name))
        except FileNotFoundError:
            pass

    def publish(self, name: str, data: bytes) -> bool:
        """Makes the file appear with all its content; False if there is one already."""
        spare = f"{LOG}/.{uuid.uuid4().hex}"
        with self.output(spare) as f:
            f.write(data)
        try:
            if self.fs.type_name == "local":
                os.link(self.path(spare), self.path(name))
            elif self.fs.get_file_info(self.path(name)).type != arrow_fs.FileType.NotFound:
                return False
            else:
                self.move(spare, name)  # fails if another writer was faster
        except OSError:
            if self.read(name) is None:
                raise
            return False
        finally:
            self.remove(spare)
        return True

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.path(folder), allow_not_found=True))
        return [os.path.basename(f.path) for f in found]


def _sha(*parts: bytes) -> str:
    return hashlib.sha256(b"".join(parts)).hexdigest()


def leaf_hash(number: int, rows: int, files: list[dict]) -> str:
    text = f"{number}|{rows}|" + ",".join(f"{f['name']}:{f['sha256']}:{f['rows']}" for f in files)
    return _sha(b"\0", text.encode())


def node_hash(left: str, right: str) -> str:
    return _sha(b"\1", bytes.fromhex(left), bytes.fromhex(right))


def folded(peaks: list[str]) -> str:
    """The root over peaks, the largest first; of an empty log, the digest of nothing."""
    if not peaks:
        return _sha()
    root = peaks[-1]
    for peak in reversed(peaks[:-1]):
        root = node_hash(peak, root)
    return root


def _name(number: int) -> str:
    return f"{LOG}/{number:020d}.json"


@dataclass
class History:
    folder: Folder

    def record(self, number: int) -> dict | None:
        data = self.folder.read(_name(number))
        return json.loads(data) if data is not None else None

    def size(self, at_least: int = 0) -> int:
        """The number of records: numbers have no gap, so doubling steps and halving find the end in O(log n) reads."""
        low, step = at_least, 1
        while self.folder.read(_name(low + step - 1)) is not None:
            low, step = low + step, step * 2
        while step > 1:
            step //= 2
            if self.folder.read(_name(low + step - 1)) is not None:
                low += step
        return low

    def head(self) -> dict | None:
        n = self.size()
        return self.record(n - 1) if n else None

    def append(self, files: list[dict], expected: int | None = None, stream: tuple[str, int] | None = None) -> int:
        """The number of the new record. With ``expected``, only as that number; a stream's batch is taken once."""
        files = sorted(files, key=lambda f: f["name"])
        number = self.size()
        while True:
            last = self.record(number - 1) if number else None
            streams = dict(last["streams"]) if last else {}
            if stream and streams.get(stream[0], -1) >= stream[1]:
                return number - 1
            if expected is not None and number != expected:
                raise LogMoved(f"another writer has taken batch {expected}")
            if stream:
                streams[stream[0]] = stream[1]
            rows = sum(f["rows"] for f in files)
            nodes, peaks = [leaf_hash(number, rows, files)], list(last["peaks"]) if last else []
            for _ in range(((number + 1) & -(number + 1)).bit_length() - 1):
                nodes.append(node_hash(peaks.pop(), nodes[-1]))
            peaks.append(nodes[-1])
            record = {"number": number, "rows": rows, "files": files, "leaf": nodes[0], "nodes": nodes, "peaks": peaks, "root": folded(peaks), "streams": streams}
            if self.folder.publish(_name(number), json.dumps(record).encode()):
                return number
            number += 1  # taken meanwhile; appends don't depend on one another unless expected says so

    # proofs

    def _range(self, a: int, b: int, read: Callable[[int], dict]) -> str:
        """The hash of records [a, b), a part of a tree that begins at a multiple of its size."""
        size = b - a
        if size & (size - 1) == 0:
            return read(b - 1)["nodes"][size.bit_length() - 1]
        k = 1 << (size - 1).bit_length() - 1
        return node_hash(self._range(a, a + k, read), self._range(a + k, b, read))

    def inclusion(self, number: int, size: int) -> list[str]:
        """Hashes that lead from the record to the root of the first ``size`` records, the lowest first."""
        if not 0 <= number < size:
            raise ValueError("no such record")
        out, a, b = [], 0, size
        while b - a > 1:
            k = 1 << (b - a - 1).bit_length() - 1
            if number < a + k:
                out.append(self._range(a + k, b, self.record))
                b = a + k
            else:
                out.append(self._range(a, a + k, self.record))
                a += k
        return out[::-1]

    def consistency(self, old: int, size: int) -> list[str]:
        """Hashes that lead from the root of the first ``old`` records to that of the first ``size``."""
        if not 0 < old <= size:
            raise ValueError("no such size")
        out, a, b, whole = [], 0, size, True
        while old != b:
            k = 1 << (b - a - 1).bit_length() - 1
            if old <= a + k:
                out.append(self._range(a + k, b, self.record))
                b = a + k
            else:
                out.append(self._range(a, a + k, self.record))
                a, whole = a + k, False
        return ([] if whole else [self._range(a, b, self.record)]) + out[::-1]


def included(leaf: str, number: int, size: int, proof: list[str], root: str) -> bool:
    """Whether the proof leads from the leaf to the root."""
    sides, a, b = [], 0, size
    while b - a > 1:
        k = 1 << (b - a - 1).bit_length() - 1
        right = number >= a + k
        sides.append(right)
        a, b = (a + k, b) if right else (a, a + k)
    if len(sides) != len(proof):
        return False
    for right, other in zip(reversed(sides), proof, strict=True):
        leaf = node_hash(other, leaf) if right else node_hash(leaf, other)
    return leaf == root


def consistent(old: int, old_root: str, size: int, root: str, proof: list[str]) -> bool:
    """Whether the proof shows that the older tree is a beginning of the newer one."""
    sides, a, b, whole = [], 0, size, True
    while old != b:
        k = 1 << (b - a - 1).bit_length() - 1
        right = old > a + k
        sides.append(right)
        whole = whole and not right
        a, b = (a + k, b) if right else (a, a + k)
    rest = list(proof)
    if len(rest) != len(sides) + (not whole):
        return False
    one = two = old_root if whole else rest.pop(0)
    for right, other in zip(reversed(sides), rest, strict=True):
        one = node_hash(other, one) if right else one
        two = node_hash(other, two) if right else node_hash(two, other)
    return (one, two) == (old_root, root)


# the same over all records, by Spark


def _join(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def faults(records: DataFrame, stored: DataFrame) -> DataFrame:
    """One row of counts: numbers, leaves, nodes, peaks and roots that are wrong, and files
    that are missing or changed (``stored``: name, sha256). Nothing else leaves the executors."""
    each = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["name"], f["sha256"], f["rows"].cast("string"))), ",")
    leaf = F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(F.concat_ws("|", F.col("number").cast("string"), F.col("rows").cast("string"), each), "UTF-8")), 256)
    total = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["rows"])
    whole = F.try_element_at("peaks", F.lit(-1))
    root = F.aggregate(F.reverse(F.slice("peaks", 1, F.greatest(F.size("peaks") - 1, F.lit(0)))), whole, lambda acc, peak: _join(peak, acc))
    n = F.col("number") + 1
    bits = F.filter(F.sequence(F.lit(62), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftright", n, b).bitwiseAND(F.lit(1).cast("long")) == 1)
    low = F.size("nodes") - 1
    shaped = (F.size("peaks") == F.size(bits)) & (low == F.element_at(bits, -1)) & (F.col("nodes")[0] == F.col("leaf")) & (F.element_at("nodes", -1) == whole)
    own = records.agg(
        (F.max("number") + 1 - F.count_distinct("number") + F.count("*") - F.count_distinct("number")).alias("numbers"),
        F.count_if(~F.coalesce((leaf == F.col("leaf")) & (total == F.col("rows")), F.lit(False))).alias("leaves"),
        F.count_if(~F.coalesce(shaped & (root == F.col("root")), F.lit(False))).alias("roots"),
    )
    node = records.select("number", F.posexplode("nodes").alias("level", "hash"))
    node = node.select("level", (F.call_function("shiftright", F.col("number") + 1, F.col("level")) - 1).alias("at"), "hash")
    inner = node.where("level > 0").select("level", "at", "hash", (F.col("level") - 1).alias("below"), (F.col("at") * 2).alias("one"), (F.col("at") * 2 + 1).alias("two"))
    child = lambda name: node.select(F.col("level").alias("below"), F.col("at").alias(name), F.col("hash").alias(f"{name}_hash"))
    met = inner.join(child("one"), ["below", "one"], "left").join(child("two"), ["below", "two"], "left")
    nodes = met.agg(F.count_if(~F.coalesce(_join(F.col("one_hash"), F.col("two_hash")) == F.col("hash"), F.lit(False))).alias("nodes"))
    peak = records.select(n.alias("n"), F.inline(F.arrays_zip(bits.alias("level"), F.col("peaks").alias("peak")))).toDF("n", "level", "peak")
    peak = peak.select("level", (F.call_function("shiftright", F.col("n"), F.col("level")) - 1).alias("at"), "peak")
    peaks = peak.join(node, ["level", "at"], "left").agg(F.count_if(~F.coalesce(F.col("hash") == F.col("peak"), F.lit(False))).alias("peaks"))
    sealed = records.select(F.explode("files").alias("f")).select(F.col("f.name").alias("name"), F.col("f.sha256").alias("sealed"))
    files = sealed.join(stored, "name", "left").agg(F.count_if(~F.coalesce(F.col("sealed") == F.col("sha256"), F.lit(False))).alias("files"))
    return own.join(nodes, F.lit(True)).join(peaks, F.lit(True)).join(files, F.lit(True))  # four single rows
