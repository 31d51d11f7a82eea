"""Exact substring de-duplication by Rabin-Karp hashes of fixed-length word windows.

Every window of ``window`` consecutive words gets a polynomial rolling hash
modulo 2^64. A task first settles the repeats inside chunks of its own rows;
what is left, one occurrence of each window per chunk, goes to the task that
owns the window's minimizer (the least hash of its ``gram``-word runs; equal
windows have equal minimizers, and neighbouring windows mostly share one, so
that they travel together in one row). There, in order of (doc_id, start), all
but the first occurrence are found; minimizer and the whole hash of the window
tell windows apart. Overlapping and adjacent repeats of a document merge into
maximal intervals of words to remove.

A window that is common to a third of all documents reaches its owner at most
once per chunk, not once per document. A run that is common to many different
windows would give one task all of them: owners whose windows are estimated
(from one document in ``sample``, chosen by hash) to be more than
``owner_windows`` are dealt on by bits of the window's hash, so that each part
has about as many; equal windows stay together, so the result is the same
whatever the estimate. At most ``hot_owners`` of them, those with most windows,
are dealt on; any other owner has less than one in ``hot_owners`` of all windows.

A false match takes two different
windows that agree in all 64 bits of their hash and, unless they are of one
chunk, in their minimizer.

Edge cases: null and short texts have no window and stay; rows without doc_id
take part in no comparison and stay; rows that repeat a doc_id are the same
document and each get its intervals; equal windows of one document count, by
start. Whole texts are read; a chunk holds at least one whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import ROW, carry, words

U = np.uint64
#: The odd base of the rolling hash and its inverse modulo 2^64.
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A run's windows by their hashes of 8 bytes; or a repeat's end, in 4 bytes.
RUNS = "owner long, doc_id long, start int, hashes binary"


@dataclass(frozen=True)
class Params:
    window: int = 20
    gram: int = 5
    chunk_words: int = 1_000_000
    sample: int = 64
    owner_windows: int = 500_000
    hot_owners: int = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def rolling(w: np.ndarray, n: int) -> np.ndarray:
    """The mixed polynomial hash of each n consecutive values, from prefix sums."""
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(len(w), BASE, U))
        down = np.multiply.accumulate(np.full(len(w), INVERSE, U))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(w * up, dtype=U)])
        return _mix((sums[n:] - sums[:-n]) * down[: len(w) - n + 1])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _pieces(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and after-last positions of the stretches of set flags, cut before each break."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = breaks.copy()
    cut[0] = True
    cut[1:] |= flag[1:] != flag[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(flag))
    on = flag[first]
    return first[on], last[on]


def _rows(owner, doc, start, offsets, data) -> pa.RecordBatch:  # noqa: ANN001
    hashes = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)), hashes], ["owner", "doc_id", "start", "hashes"])


Hot = tuple[np.ndarray, np.ndarray]  #: owners to deal on, in order, and into how many parts (powers of 2)


def _deal_on(owner: np.ndarray, h: np.ndarray, hot: Hot) -> np.ndarray:
    """The owners of windows, hot ones by part."""
    if not len(hot[0]):
        return owner
    at = np.minimum(np.searchsorted(hot[0], owner), len(hot[0]) - 1)
    part = np.where(hot[0][at] == owner, (h >> U(7)) & (hot[1][at] - U(1)), U(0))
    return np.where(part > 0, _mix(owner ^ _mix(part)), owner)


def _chunk(ids: np.ndarray, lengths: np.ndarray, w: np.ndarray, p: Params, hot: Hot) -> Iterator[pa.RecordBatch]:
    """Runs of windows that are first in this chunk (with hashes), and intervals of its repeats (without)."""
    order = np.argsort(ids, kind="stable")
    begin = np.cumsum(lengths) - lengths
    at = np.concatenate([np.arange(begin[i], begin[i] + lengths[i]) for i in order]) if len(order) else np.zeros(0, np.int64)
    w, ids, lengths = w[at], ids[order], lengths[order]
    begin = np.cumsum(lengths) - lengths
    if len(w) < p.window:
        return
    every = rolling(w, p.window)
    least = _least(rolling(w, p.gram), p.window - p.gram + 1)
    doc_of = np.repeat(np.arange(len(ids)), np.maximum(0, lengths - p.window + 1))
    if not len(doc_of):
        return
    fits = np.maximum(0, lengths - p.window + 1)
    start = np.arange(len(doc_of)) - np.repeat(np.cumsum(fits) - fits, fits)
    place = begin[doc_of] + start
    h = every[place]
    owner = _deal_on(least[place], h, hot)
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    lead = np.concatenate([[True], ~same])
    first = by[np.flatnonzero(lead)[np.cumsum(lead) - 1]]  # of the same hash, for each in order
    again = np.zeros(len(h), bool)
    again[by] = ~lead
    itself = np.zeros(len(h), bool)
    itself[by] = ~lead & (ids[doc_of[by]] == ids[doc_of[first]]) & (start[by] == start[first])
    new_doc = np.concatenate([[True], doc_of[1:] != doc_of[:-1]])
    a, b = _pieces(again & ~itself, new_doc)
    if len(a):
        doc = ids[doc_of[a]]
        yield _rows(_mix(doc.astype(U)).view(np.int64), doc, start[a], np.arange(len(a) + 1) * 4, (start[b - 1] + p.window).astype("<i4"))
    a, b = _pieces(~again, new_doc | np.concatenate([[True], owner[1:] != owner[:-1]]))
    keep = np.repeat(np.arange(len(a)), b - a)
    inside = np.arange(len(keep)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[keep]
    whole = h[inside].astype("<u8")
    ends = np.concatenate([[0], np.cumsum(b - a)])
    for i in range(0, len(a), 50_000):
        j = min(len(a), i + 50_000)
        yield _rows(owner[a[i:j]].view(np.int64), ids[doc_of[a[i:j]]], start[a[i:j]], (ends[i : j + 1] - ends[i]) * 8, whole[ends[i] : ends[j]])


def _firsts(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first position of each (group, h), and for every position which of them it repeats."""
    by = np.lexsort((h, group))
    lead = np.ones(len(h), bool)
    lead[1:] = (h[by][1:] != h[by][:-1]) | (group[by][1:] != group[by][:-1])
    back = np.empty(len(h), np.int64)
    back[by] = np.cumsum(lead) - 1
    return by[lead], back


def _owned(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Intervals of all but the first occurrences; rows come by owner, doc_id and start."""
    last: int | None = None  # the owner that may go on in the next batch, and its windows so far
    seen = (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    schema = ["doc_id", "start", "upto"]
    for batch in batches:
        owner, doc, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("owner", "doc_id", "start"))
        hashes = batch.column("hashes")
        offsets = np.frombuffer(hashes.buffers()[1], np.int32, len(hashes) + 1, hashes.offset * 4)
        done = np.diff(offsets) == 4
        if done.any():
            upto = np.frombuffer(b"".join(hashes.filter(pa.array(done)).to_pylist()), "<i4")
            yield pa.RecordBatch.from_arrays([pa.array(doc[done]), pa.array(start[done]), pa.array(upto)], schema)
            owner, doc, start = owner[~done], doc[~done], start[~done]
            hashes = hashes.filter(pa.array(~done))
            offsets = np.frombuffer(hashes.buffers()[1], np.int32, len(hashes) + 1, hashes.offset * 4) if len(hashes) else offsets
        if not len(owner):
            continue
        h = np.frombuffer(hashes.buffers()[2], "<u8", (offsets[-1] - offsets[0]) // 8, offsets[0])
        size = np.diff(offsets) // 8
        row = np.repeat(np.arange(len(owner)), size)
        pos = start[row].astype(np.int64) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        group = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
        ids = doc[row]
        first, back = _firsts(group[row], h)
        lead = first[back]
        repeat = (lead != np.arange(len(h))) & ~((ids == ids[lead]) & (pos == pos[lead]))
        if last is not None and owner[0] == last and len(seen[0]):
            mine = np.flatnonzero(group[row] == 0)
            i = np.minimum(np.searchsorted(seen[0], h[mine]), len(seen[0]) - 1)
            repeat[mine] |= (seen[0][i] == h[mine]) & ~((seen[1][i] == ids[mine]) & (seen[2][i] == pos[mine]))
        end = first[group[row[first]] == group[-1]]  # the last owner's windows
        if last is None or owner[-1] != last:
            seen = (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        last = owner[-1]
        parts = [np.concatenate([x, y]) for x, y in zip(seen, (h[end], ids[end], pos[end]), strict=True)]
        _, keep = np.unique(parts[0], return_index=True)  # the earlier of equal ones
        seen = (parts[0][keep], parts[1][keep], parts[2][keep])
        a, b = _pieces(repeat, np.concatenate([[True], row[1:] != row[:-1]]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(pos[a].astype(np.int32)), pa.array((pos[b - 1] + p.window).astype(np.int32))], schema)


def _hashed(docs: DataFrame, p: Params) -> DataFrame:
    """Rows (doc_id, h) of the documents that have a window, h the hashes of their words."""
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.where(F.size("h") >= p.window)


def hot_owners(docs: DataFrame, p: Params = Params()) -> Hot:
    """The owners that are dealt on; an estimate, on which no result depends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h")
            ends, values = h.offsets.to_numpy(), h.values.to_numpy(zero_copy_only=False).view(U)
            own = [_least(rolling(values[a:b], p.gram), p.window - p.gram + 1) for a, b in zip(ends, ends[1:], strict=False)]
            if own:
                owner, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(n.astype(np.int64) * p.sample)], ["owner", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(p.sample)) == 0)
    counts = _hashed(some, p).mapInArrow(count, "owner long, n long").groupBy("owner").agg(F.sum("n").alias("n")).where(F.col("n") > p.owner_windows)
    found = counts.orderBy(F.desc("n"), "owner").limit(p.hot_owners).collect()
    owner, n = np.array([r["owner"] for r in found], np.int64).view(U), np.array([r["n"] for r in found], float)
    by = np.argsort(owner)
    return owner[by], (2 ** np.ceil(np.log2(np.maximum(1, n[by] / p.owner_windows)))).astype(U)


def repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (doc_id, start, upto): words that windows with an earlier equal one cover."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_owners(docs, p))  # hot_owners at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            if ids:
                yield from _chunk(np.concatenate(ids), np.concatenate(sizes), np.concatenate(flat), p, hot.value)
            ids.clear(), sizes.clear(), flat.clear()

        for batch in batches:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            h = batch.column("h")
            ends = h.offsets.to_numpy()
            values = h.values.to_numpy(zero_copy_only=False).view(U)
            i = 0
            while i < len(doc):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + p.chunk_words - n, side="right")) - 1)
                j = min(j, len(doc))
                ids.append(doc[i:j])
                sizes.append(np.diff(ends[i : j + 1]).astype(np.int64))
                flat.append(values[ends[i] : ends[j]])
                n += int(ends[j] - ends[i])
                i = j
                if n >= p.chunk_words or i < len(doc):
                    yield from out()
                    n = 0
        yield from out()

    runs = _hashed(docs, p).mapInArrow(scan, RUNS)
    dealt = runs.repartition("owner").sortWithinPartitions("owner", "doc_id", "start")
    return dealt.mapInArrow(lambda batches: _owned(batches, p), "doc_id long, start int, upto int")


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals of overlapping and adjacent ones."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed, removed (maximal intervals) and kept_text,
    the kept words joined by one space; columns so named are replaced."""
    made = ("n_words", "n_removed", "removed", "kept_text")
    spans = repeats(docs, p).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("start").alias("_a"), F.collect_list("upto").alias("_b"))

    @F.pandas_udf("struct<n_words long, n_removed long, removed array<struct<start int, end int>>, kept_text string>")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(text, starts, ends, strict=True):
            found = t.encode().split() if t else []
            gone = merged(list(zip(a.tolist(), b.tolist(), strict=True))) if a is not None else []
            kept, at = [], 0
            for x, y in gone:
                kept += found[at:x]
                at = y
            kept += found[at:]
            rows.append((len(found), len(found) - len(kept), [{"start": x, "end": y} for x, y in gone], b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=list(made))

    held, laid_out = carry(docs, made, F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    joined = held.join(spans.hint("shuffle_hash"), F.col("_id") == F.col("_doc"), "left")
    return laid_out(joined.select(ROW, cut("_text", "_a", "_b").alias("c")), *(f"c.{c}" for c in made))
