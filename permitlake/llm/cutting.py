"""Packing by cutting stock: patterns of document lengths from a linear program.

A document's tokens (its ids and an end id) fill as many whole sequences as they
can; what is left, shorter than a sequence, is an item. Items of equal length are
alike, so the plan needs only the histogram of lengths, which has fewer rows than
a sequence has tokens, however large the table is.

* ``solve``: the linear program over patterns (multisets of lengths that fill a
  sequence whose size is a power of two, so that nothing is padded) covers the
  histogram at the least cost. Columns are generated: a knapsack dynamic program
  over fills finds, at the program's dual prices, the best completion of every
  length. Histograms of more than ``rows`` lengths are dealt into programs of
  that size, solved as Spark tasks. An item alone in a padded sequence is the
  column of last resort.
* ``rounded``: copies are rounded down, then up while items are left.
* ``complete``: what remains, a number of items that is bounded by the number of
  columns (last-resort columns aside), is filled exactly by subset sums over the
  items left. Lengths that no exact fill takes in make up the strip: they are
  laid end to end and cut where a sequence ends, the tail at powers of two.

The plan names, for each length, ranges of ranks. A document's rank among those
of its length comes from counts per stored partition and length, so no task sees
all documents of a length and none is sorted.

Ids are the tokenizer's own: it drops white space and never joins what stands on
either side of it, so a text's ids are those of its words (``Ids``), which are
looked up where they were met before.

Edge cases: a null or empty text is the end id alone; an empty table packs into
nothing; repeated rows and null ids are documents like others (rows are told
apart by their place in the written table). Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.llm.common import materialize

#: Words between white space; text of which Python's rules give the tokenizer's
#: units (no ``<|`` of a special token); those units.
WORD = re.compile(r"[^ \t\n\r]+")
PLAIN = re.compile(r"(?:[ \t\n\r!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+|<(?!\|))*+")
UNIT = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")
#: A byte as the model's vocabulary shows it: itself if printable, else the next free sign from 256 on.
_UNSHOWN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SHOWN = {b: 256 + i for i, b in enumerate(_UNSHOWN)}
TOKENS = "part int, k long, doc_id long, doc_tokens long, rest int, place long, fulls long, full_crc array<long>, rest_crc long, ids binary"
LAYOUT = "part int, k long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Params:
    capacity: int = 4096  #: a power of two
    end: int = 2
    rows: int = 512  #: lengths in one linear program
    columns: int = 64  #: columns that one pricing adds at most
    pivots: int = 500  #: of one program; fewer cost quality, not correctness
    gap: float = 1e-3  #: from the bound, at which a program ends
    charge: int = 256  #: what a sequence costs beside its tokens, so that long ones are preferred
    words: int = 300_000  #: words whose ids a task remembers


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids(dict):
    """Words to their ids as little-endian bytes; a memory of the latest ``limit``, not a bound on words.

    Plain words (``PLAIN``: ASCII and Latin letters, for which Python's and the
    tokenizer's rules for letters and cases are the same) are lower-cased and cut
    into the tokenizer's units here, and units go to its model; other words go
    through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.rest = self.tokenizer.model, {}

    def __missing__(self, unit: str) -> bytes:
        seen = unit if unit.isascii() else unit.encode().decode("latin-1").translate(SHOWN)
        ids = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        if len(unit) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, UNIT.findall(text.lower())))
        return b"".join(self.of(w) if PLAIN.fullmatch(w) else self._whole(w) for w in WORD.findall(text))

    def _whole(self, word: str) -> bytes:
        ids = self.rest.get(word)
        if ids is None:
            ids = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            if len(word) <= 64:
                if len(self.rest) >= self.limit // 8:
                    self.rest.clear()
                self.rest[word] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _ids(path: str, limit: int) -> Ids:
    return Ids(path, limit)


def tokens(docs: DataFrame, path: str | None = None, p: Params = Params()) -> DataFrame:
    """The documents' ids, and what the plan needs of them, as a written table."""
    path, cap = path or vocabulary_path(), p.capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end = _ids(path, p.words), np.array([p.end], "<u4").tobytes()
        part, k, fulls, seen = TaskContext.get().partitionId(), 0, 0, Counter()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = ids.of(text) + end
                n = len(data) // 4
                full, rest = divmod(n, cap)
                crc = [zlib.crc32(data[4 * cap * i : 4 * cap * (i + 1)]) for i in range(full)]
                rows.append((part, k, doc_id, n, rest, seen[rest], fulls, crc, zlib.crc32(data[4 * cap * full :]), data))
                k, fulls = k + 1, fulls + full
                seen[rest] += 1
            out = pd.DataFrame(rows, columns=["part", "k", "doc_id", "doc_tokens", "rest", "place", "fulls", "full_crc", "rest_crc", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, TOKENS), "cutting-tokens")


# the plan: histogram to patterns

Pattern = dict[int, int]  #: length to its number of items


def _sizes(p: Params) -> list[int]:
    return [1 << i for i in range(p.capacity.bit_length())]


def _best_fills(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fill, the greatest total price of lengths that make it up exactly, and the length used last."""
    value, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    value[0] = 0.0
    for f in range(int(lengths[0]), capacity + 1):
        use = lengths[: np.searchsorted(lengths, f, side="right")]
        total = value[f - use] + prices[: len(use)]
        at = int(total.argmax())
        value[f], last[f] = total[at], at
    return value, last


def _priced(lengths: np.ndarray, demand: np.ndarray, prices: np.ndarray, p: Params) -> list[tuple[float, np.ndarray]]:
    """New columns (cost, items of each length) that pay at these prices, the best first."""
    value, last = _best_fills(lengths, prices, p.capacity)
    found: list[tuple[float, int, int]] = []
    for size in _sizes(p):
        use = lengths[: np.searchsorted(lengths, size, side="right")]
        gain = prices[: len(use)] + value[size - use] - (size + p.charge)
        found += [(float(gain[i]), size, int(i)) for i in np.flatnonzero(gain > 1e-6 * p.capacity)]
    out: dict[bytes, tuple[float, np.ndarray]] = {}
    for _, size, i in sorted(found, key=lambda x: (-x[0], x[1:])):
        column, left = np.zeros(len(lengths)), size - int(lengths[i])
        column[i] = 1
        while left:
            column[last[left]] += 1
            left -= int(lengths[last[left]])
        if (column <= demand).all():
            out.setdefault(column.tobytes(), (size + p.charge, column))
        if len(out) == p.columns:
            break
    return list(out.values())


def _start(lengths: np.ndarray, demand: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A basis, its costs and amounts: exact fills by the lengths that aren't used up, the longest first.

    Each fill uses a length up (its column stands at that length's place), and later
    ones don't hold it, so the basis is triangular.
    """
    m = len(lengths)
    at = {int(n): i for i, n in enumerate(lengths)}
    basis, cost, amount = np.zeros((m, m)), np.zeros(m), np.zeros(m)
    left, order = demand.astype(float), [int(n) for n in reversed(lengths)]
    while order:
        n = order[0]
        many = {k: p.capacity // k for k in order}
        found = next((f for size in reversed(_sizes(p)) if size >= n and (f := _exact(many, order, n, size))), None)
        use = found or {n: 1}
        copies, out = min((left[at[k]] / a, at[k]) for k, a in use.items())
        for k, a in use.items():
            basis[at[k], out] = a
            left[at[k]] -= copies * a
        left[out] = 0.0
        cost[out], amount[out] = (sum(k * a for k, a in use.items()) if found else p.capacity) + p.charge, copies
        order = [k for k in order if left[at[k]] > 1e-9]
    empty = np.flatnonzero(~basis.any(axis=0))  # lengths used up together with another
    basis[empty, empty] = 1.0
    cost[empty] = p.capacity + p.charge
    return basis, cost, amount


def solve(lengths: np.ndarray, demand: np.ndarray, p: Params = Params()) -> list[tuple[float, np.ndarray]]:
    """The linear program's solution (copies, items of each length) in columns without padding.

    Revised simplex over generated columns; it ends where no column pays, or at a
    cost within ``gap`` of the bound that all sequences are full.
    """
    m = len(lengths)
    basis, cost, amount = _start(lengths, demand, p)
    inverse = np.linalg.inv(basis)
    least = float((lengths * demand).sum()) * (1 + p.charge / p.capacity)
    pool, pool_cost = np.zeros((m, 0)), np.zeros(0)
    for pivot in range(p.pivots):
        if cost @ amount <= least * (1 + p.gap):
            break
        prices = cost @ inverse
        reduced = pool_cost - prices @ pool
        if not len(reduced) or reduced.min() > -1e-6 * p.capacity:
            new = _priced(lengths, demand, prices, p)
            if not new:
                break
            keep = slice(max(0, pool.shape[1] - 40 * p.columns), None)
            pool, pool_cost = np.column_stack([pool[:, keep], *(c for _, c in new)]), np.append(pool_cost[keep], [c for c, _ in new])
            reduced = pool_cost - prices @ pool
        j = int(reduced.argmin())
        way = inverse @ pool[:, j]
        able = way > 1e-9
        if reduced[j] >= 0 or not able.any():
            break
        ratio = np.where(able, amount / np.where(able, way, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * way, 0.0)
        amount[out] = step
        basis[:, out], cost[out] = pool[:, j], pool_cost[j]
        if pivot % 200 == 199:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    fills = lengths @ basis
    return [(float(amount[i]), basis[:, i]) for i in range(m) if amount[i] > 1e-9 and round(fills[i]) in _sizes(p)]


def rounded(lengths: np.ndarray, demand: np.ndarray, solution: list[tuple[float, np.ndarray]]) -> list[tuple[int, Pattern]]:
    """Whole copies of columns: rounded down, then one more of each while its items are left, most fractional first."""
    left, copies = demand.astype(np.int64).copy(), [0] * len(solution)

    def take(i: int, most: int) -> None:
        column = solution[i][1].astype(np.int64)
        use = column > 0
        n = int(min(most, (left[use] // column[use]).min()))
        left[use] -= n * column[use]
        copies[i] += n

    for i, (x, _) in enumerate(solution):
        take(i, int(x + 1e-6))
    for i in sorted(range(len(solution)), key=lambda i: -(solution[i][0] % 1)):
        take(i, 1)
    return [(n, {int(lengths[k]): int(c[k]) for k in np.flatnonzero(c)}) for n, (_, c) in zip(copies, solution, strict=True) if n]


def _exact(left: dict[int, int], order: list[int], first: int, target: int) -> Pattern | None:
    """Items left that fill the target exactly with one of the first length; longer ones are tried first."""
    want, reach, steps = target - first, 1, []
    mask = (1 << (want + 1)) - 1
    for n in order:
        if reach >> want & 1:
            break
        most = min(left[n] - (n == first), want // n)
        take = 1
        while most > 0:
            take = min(take, most)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            most -= take
            take *= 2
    if not reach >> want & 1:
        return None
    used = Counter({first: 1})
    for n, take, before in reversed(steps):
        if not before >> want & 1:
            used[n] += take
            want -= n * take
    return dict(used)


def complete(left: dict[int, int], p: Params = Params()) -> tuple[list[tuple[int, Pattern]], dict[int, int]]:
    """Patterns that fill sequences exactly with the items left, and what no exact fill takes in."""
    left, strip, out = dict(left), {}, []
    order = sorted((n for n, c in left.items() if c), reverse=True)
    while order:
        n = order[0]
        found = next((f for size in reversed(_sizes(p)) if size >= n and (f := _exact(left, order, n, size))), None)
        if found is None:
            strip[n] = left.pop(n)
            order.pop(0)
            continue
        copies = min(left[k] // a for k, a in found.items())
        out.append((copies, found))
        for k, a in found.items():
            left[k] -= copies * a
        order = [k for k in order if left[k]]
    return out, strip


@dataclass
class Plan:
    """Where the item of a length and rank goes; arrays by range of ranks, in order of (length, first rank)."""

    key: np.ndarray
    first: np.ndarray
    base: np.ndarray  #: the first sequence of the range; -1 in the strip
    items: np.ndarray
    offset: np.ndarray  #: in the sequence; in the strip, the place
    strip_base: int
    ends: np.ndarray  #: where the strip's last sequences end
    params: Params = field(default_factory=Params)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence (-1: strip), offset, place in the strip."""
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        n, items = rank - self.first[at], np.maximum(self.items[at], 1)
        strip = self.base[at] < 0
        sequence = np.where(strip, -1, self.base[at] + n // items)
        return sequence, np.where(strip, 0, self.offset[at] + n % items * length), np.where(strip, self.offset[at] + n * length, 0)

    def cut(self, a: int, b: int) -> list[tuple[int, int, int, int]]:
        """The strip's pieces of [a, b): beginning, length, sequence, offset."""
        cap, whole, out = self.params.capacity, self.ends[0], []
        while a < b:
            if a < whole:
                number, begin, end = a // cap, a - a % cap, a - a % cap + cap
            else:
                i = int(np.searchsorted(self.ends, a, side="right"))
                number, begin, end = whole // cap + i - 1, self.ends[i - 1], self.ends[i]
            out.append((a, int(min(b, end)) - a, int(self.strip_base + number), int(a - begin)))
            a = int(min(b, end))
        return out


def arranged(patterns: list[tuple[int, Pattern]], strip: dict[int, int], p: Params = Params()) -> Plan:
    """Ranges of ranks for the patterns' copies and for the strip."""
    taken, rows, sequence = Counter(), [], 0
    for copies, pattern in patterns:
        offset = 0
        for n, a in sorted(pattern.items(), reverse=True):
            rows.append((n, taken[n], sequence, a, offset))
            taken[n] += copies * a
            offset += n * a
        sequence += copies
    at = 0
    for n, count in sorted(strip.items(), reverse=True):
        rows.append((n, taken[n], -1, 0, at))
        at += n * count
    tail = [size for size in reversed(_sizes(p)) if at % p.capacity & size]
    ends = np.cumsum([at - at % p.capacity, *tail])
    length, first, base, items, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan((length << 48) + first, first, base, items, offset, sequence, ends, p)


def planned(histogram: DataFrame, p: Params = Params()) -> Plan:
    """The plan for rows (rest, n): programs as Spark tasks, the bounded remainder here."""
    spark = histogram.sparkSession
    demand = {int(r["rest"]): int(r["n"]) for r in histogram.collect()}  # under capacity rows
    programs = max(1, -(-len(demand) // p.rows))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        lengths, wanted = pdf["length"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        found = rounded(lengths, wanted, solve(lengths, wanted, p))
        return pd.DataFrame([(n, list(f), list(f.values())) for n, f in found], columns=["copies", "lengths", "items"])

    rows = [(n, c, zlib.crc32(str(n).encode()) % programs) for n, c in demand.items()]
    dealt = spark.createDataFrame(rows, "length long, n long, program long").repartition(programs, "program")
    solved = dealt.groupBy("program").applyInPandas(one, "copies long, lengths array<long>, items array<long>")
    patterns = sorted((r["copies"], tuple(sorted(zip(r["lengths"], r["items"], strict=True)))) for r in solved.collect())  # a row per column of a basis
    patterns = [(n, dict(f)) for n, f in patterns]
    for n, f in patterns:
        for k, a in f.items():
            demand[k] -= n * a
    more, strip = complete(demand, p)
    return arranged(patterns + more, strip, p)


# the layout


def pack(docs: DataFrame, path: str | None = None, p: Params = Params()) -> DataFrame:
    """Rows (part, k, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece."""
    return lay_out(tokens(docs, path, p), p)


def lay_out(table: DataFrame, p: Params = Params()) -> DataFrame:
    items = table.where("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("n"))
    items = materialize(items, "cutting-lengths")
    plan = planned(items.groupBy("rest").agg(F.sum("n").alias("n")), p)
    before = items.select("rest", "part", (F.sum("n").over(W.partitionBy("rest").orderBy("part")) - F.col("n")).alias("before"))  # a row per partition and length
    shared = table.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, cap = shared.value, p.capacity
        for pdf in batches:
            sequence, offset, strip = plan.place(pdf["rest"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)) if len(plan.key) else [np.zeros(len(pdf), int)] * 3
            rows = []
            for i, r in enumerate(pdf.itertuples(index=False)):
                own = lambda start, n, crc, number, at, r=r: rows.append((r.part, r.k, r.doc_id, start, n, crc, r.doc_tokens, number, at))
                for j, crc in enumerate(r.full_crc):
                    own(j * cap, cap, crc, 2 * ((r.part << 32) + r.fulls + j) + 1, 0)
                start = len(r.full_crc) * cap
                if not r.rest:
                    continue
                if sequence[i] >= 0:
                    own(start, r.rest, r.rest_crc, 2 * int(sequence[i]), int(offset[i]))
                    continue
                cuts = plan.cut(int(strip[i]), int(strip[i]) + r.rest)
                for a, n, number, at in cuts:
                    own(start + a - int(strip[i]), n, r.rest_crc if len(cuts) == 1 else -1, 2 * number, at)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in LAYOUT.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    slim = table.drop("ids").join(before, ["rest", "part"], "left")
    ranked = slim.withColumn("rank", F.col("place") + F.coalesce("before", F.lit(0))).drop("place", "before")
    pieces = materialize(ranked.mapInPandas(put, LAYOUT), "cutting-pieces")

    @F.pandas_udf("long")
    def crc(ids: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(d[4 * a : 4 * (a + n)]) for d, a, n in zip(ids, start, length, strict=True)], dtype="int64")

    cut = pieces.where("ids_crc32 < 0").join(table.select("part", "k", "ids"), ["part", "k"]).withColumn("ids_crc32", crc("ids", "start", "length"))
    return pieces.where("ids_crc32 >= 0").unionByName(cut.select(pieces.columns))


def sequences(table: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids): the packed sequences' ids as little-endian 32-bit bytes."""
    parts = layout.join(table.select("part", "k", "ids"), ["part", "k"]).select("sequence_id", "offset", F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")).alias("ids"))
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return ordered.select("sequence_id", F.aggregate(F.transform("p", lambda x: x.ids), F.lit("").cast("binary"), lambda a, b: F.concat(a, b)).alias("ids"))
