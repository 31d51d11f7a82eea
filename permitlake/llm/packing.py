"""Best-fit packing of token pieces into sequences, certified by lower bounds.

``pieces`` tokenizes whole documents, ends each with id 0 and cuts those longer
than a sequence, the first piece being the shorter one. ``pack`` spreads the
pieces over partitions of about ``part_rows`` by a hash, packs each by best-fit
decreasing and bounds its number of sequences from below by dual-feasible
functions; the same bound over all lengths certifies the whole. While more
sequences are in use than that, partitions exchange documents: one that needs
just what its tokens fill (which is certified) puts up its emptiest sequence,
one with a gap all its unfilled ones. Their documents are packed anew in
partitions twice as large, at most ``rounds`` times and only while that lowers
the number of sequences.

Pieces with a ``place`` (``pieces_in_order``) keep to that order: partitions are
ranges of ``part_rows`` places, exchanges go to the neighbouring range, and the
numbers of sequences follow the ranges and, in a range, the mean place of their
documents. So a mixture's order holds for the sequences but for the documents of
one range. Other pieces are spread by a hash.

Ids come from the rank file of the tokenizer's own vocabulary where both are
known to agree, and from the tokenizer else (``encoder``).

Edge cases: a null or empty text is the single id 0; an empty table packs into
nothing; repeated rows and null ids are pieces like others (rows are told apart
by their place in the written table); equal lengths keep table order.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.llm.common import materialize

COMMON = re.compile("[^\x00-ɏ]")
LAYOUT = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, bins long, bound long"


@dataclass(frozen=True)
class Params:
    capacity: int = 2048
    part_rows: int = 20_000
    rounds: int = 4


def vocabulary_paths() -> tuple[str, str]:
    """The tokenizer file, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(paths: tuple[str, str]):  # noqa: ANN201
    """Text to ids. The rank file gives the tokenizer's ids several times faster;
    texts with characters beyond Latin, where the two libraries' Unicode tables
    might differ, go to the tokenizer itself."""
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(paths[1], "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> np.ndarray:
        if not COMMON.search(text) and "<|" not in text:
            return np.asarray(fast.encode_ordinary(text), "<u4")
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(paths[0]))
        return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def pieces(docs: DataFrame, paths: tuple[str, str] | None = None, p: Params = Params(), with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of the documents' pieces, with the columns kept."""
    paths = paths or vocabulary_paths()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), *keep]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(paths)
        for pdf in batches:
            rows = []
            for doc_id, text, *own_columns in zip(pdf["doc_id"], pdf["text"], *(pdf[c] for c in keep), strict=True):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                ends = range(len(ids) % p.capacity or p.capacity, len(ids) + 1, p.capacity)
                start = 0
                for k, end in enumerate(ends):
                    own = ids[start:end]
                    rows.append((doc_id, k, start, end - start, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if with_ids else []), *own_columns))
                    start = end
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInPandas(cut, schema)


def pieces_in_order(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The pieces of a table as it is stored, with the place (from 0) of their document in it.

    Files are taken in the order of their names, as Spark writes them, and rows in
    that of the file; no text is shuffled for it. What isn't stored is written first.
    """
    try:
        stored = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return pieces_in_order(materialize(docs.select("doc_id", "text"), "packing-docs"), p)
    sizes = stored.groupBy("file").agg(F.count("*").alias("n"))
    before = materialize(sizes.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("before")), "packing-files")  # a row per file
    cut = materialize(pieces(stored, p=p, keep=("file", "row")), "packing-cut")
    return cut.join(before, "file").withColumn("place", F.col("before") + F.col("row")).drop("file", "row", "before")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each length, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins, offsets, fill = 0, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = r - n
        if left:
            room[left].append(b)
            free |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that lengths with these counts (by length, 0 to capacity) need at least.

    The largest sum over two families of dual-feasible functions: thresholds,
    which round lengths over capacity - e up to all of it and drop those under
    e, and staircases floor((k+1)x)/k.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    n, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    best = 0
    for e in range(capacity // 2 + 1):
        big = int(n[-1] - n[capacity - e])
        middle = int(mass[capacity - e] - (mass[e - 1] if e else 0))
        best = max(best, -(-(big * capacity + middle) // capacity))
    for k in range(1, 33):
        exact = (sizes * (k + 1)) % capacity == 0
        value = np.where(exact, sizes * k, (sizes * (k + 1) // capacity) * capacity)
        best = max(best, -(-int(np.sum(counts * value)) // (capacity * k)))
    return best


def _pack_part(pdf: pd.DataFrame, stage: int, p: Params) -> pd.DataFrame:
    pdf = pdf.sort_values("row", kind="stable")
    lengths = pdf["length"].to_numpy(np.int64)
    bins, offsets, fill = best_fit_decreasing(lengths, p.capacity)
    bound = lower_bound(np.bincount(lengths, minlength=p.capacity + 1), p.capacity)
    tight = len(fill) == -(-int(lengths.sum()) // p.capacity)
    offered = fill < p.capacity
    if tight:
        offered &= np.arange(len(fill)) == int(np.argmin(fill))
    part, number = int(pdf["part"].iloc[0]), np.arange(len(fill))
    if "place" in pdf.columns:
        part <<= stage  # the first of the smallest ranges that this one covers
        number[np.argsort(np.bincount(bins, pdf["place"]) / np.bincount(bins), kind="stable")] = np.arange(len(fill))
    first = (part << 28) | (stage << 25)
    kept = [c for c in pdf.columns if c != "part"]
    return pdf[kept].assign(sequence_id=first + number[bins], offset=offsets, open=offered[bins], bins=len(fill), bound=bound)


def _packed(rows: DataFrame, n: int, stage: int, p: Params) -> DataFrame:
    size = p.part_rows << stage
    ordered = "place" in rows.columns
    part = F.floor(F.col("place") / size) if ordered else F.pmod(F.xxhash64("row", F.lit(stage)), F.lit(max(1, -(-n // size))))
    packed = rows.withColumn("part", part).groupBy("part").applyInPandas(lambda pdf: _pack_part(pdf, stage, p), LAYOUT + (", place long" if ordered else ""))
    return materialize(packed, f"packing-{stage}")


def pack(cut: DataFrame, p: Params = Params()) -> DataFrame:
    """The pieces with sequence_id and offset, bins and bound of their partition, and open.

    With a column place in ``cut``, partitions and sequences follow it.
    """
    place = ["place"] if "place" in cut.columns else []
    rows = materialize(cut.select("doc_id", "piece", "start", "length", "ids_crc32", *place).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    layout = _packed(rows, rows.count(), 0, p)
    closed: list[DataFrame] = []
    least = _bound(rows, p)
    used = layout.where("offset = 0").count()
    for stage in range(1, p.rounds + 1):
        if used <= least:
            break
        offered = layout.where("open")
        had = offered.agg(F.count(F.when(F.col("offset") == 0, 1)).alias("bins"), F.count("*").alias("n")).first()
        if had["bins"] < 2:
            break
        again = _packed(offered.select(rows.columns), had["n"], stage, p)
        saved = had["bins"] - again.where("offset = 0").count()
        if saved <= 0:
            break
        used -= saved
        closed.append(layout.where("not open"))
        layout = again
    for part in closed:
        layout = layout.unionByName(part)
    return layout


def _bound(rows: DataFrame, p: Params) -> int:
    counts = np.zeros(p.capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # a row per length, capacity at most
        counts[r["length"]] = r["count"]
    return lower_bound(counts, p.capacity)


def certificate(layout: DataFrame, p: Params = Params()) -> dict[str, int]:
    """Sequences used, and the least that any packing of all pieces needs."""
    return {"sequences": layout.where("offset = 0").count(), "bound": _bound(layout, p)}


def sequences(docs: DataFrame, layout: DataFrame, paths: tuple[str, str] | None = None, p: Params = Params()) -> DataFrame:
    """Rows (sequence_id, ids): the packed sequences' token ids. Needs unique doc_id."""
    ids = pieces(docs, paths, p, with_ids=True).select("doc_id", "piece", "ids")
    put = layout.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    placed = put.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return placed.select("sequence_id", F.flatten(F.transform("parts", lambda x: x.ids)).alias("ids"))
