"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

Documents with the same words are one class from the start. Of each class's
text, the five-word shingles with their counts are a weighted set. Darts are
thrown at the regions of an element's weight: per unit of weight and cell of
the rank axis a hashed Poisson number of them, each with a hashed rank,
coordinate and identity. A signature keeps the earliest dart of each of
``bands * rows`` coordinates, so that two signatures agree in a coordinate with
the probability of the texts' weighted Jaccard similarity; only ranks up to
about ``t / weight`` are looked at, which makes that t darts a text however
long, and the few texts with an empty coordinate look further.

Bands of ``rows`` coordinates are join keys. In each bucket the most central
member (the one with most bucket mates) is compared with all others by their
shingles; that settles most buckets without pairing their members. Where a
bucket still holds several components, blocks of its members meet in tasks:
all pairs of unlike components whose signatures may reach the similarity (by
five standard deviations) are compared until they are one, and only the links
that joined something are returned. So every pair that shares a bucket is
decided, and no join or group ever emits all pairs; a member goes to one task per
block of its bucket's members outside the main component. Components come from a
min-label iteration over written tables; nothing is collected.

Edge cases: null texts and texts without a word are each a class of their own;
texts under five words have one shingle, all their words; repeated rows belong
to one class; the kept document of a class is the one with the smallest doc_id
(nulls last), and one row of it only if rows repeat: of rows that share doc_id
and text but no other column, the one whose whole content has the least hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import ROW, SPACES, carry, materialize, words

U = np.uint64
NO_ID = -(1 << 63)  # stands for a null doc_id in join keys
#: Multipliers of a 64-bit finalizer, and the odd base of window hashes.
M1, M2, GOLDEN = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 18
    rows: int = 4
    texts: int = 256  #: texts whose darts are thrown together
    block: int = 400  #: bucket members that meet in a task, twice that at most


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * M1
        x = (x ^ (x >> U(27))) * M2
        return x ^ (x >> U(31))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes; one of all of them if there are fewer."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, U)
        for i in range(n):
            out = mix64(out + GOLDEN) ^ h[i : i + len(out)]
    return mix64(out + U(n))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * (1.0 / (1 << 53))


#: The rank axis in cells: two up to 1, then of length 1.
EDGES = [0.0, 0.125, 1.0]
FINE = len(EDGES) - 2


def _cell(c: int) -> tuple[float, float]:
    return (EDGES[c], EDGES[c + 1]) if c <= FINE else (float(c - FINE), float(c - FINE + 1))


def _throw(owner: np.ndarray, element: np.ndarray, last: np.ndarray, cell: int, k: int):  # noqa: ANN202
    """The darts of one cell of the rank axis for unit-weight regions: owner, coordinate, rank, identity.

    last: the part of the region's weight that the element has (1 but for the last of it).
    """
    low, high = _cell(cell)
    with np.errstate(over="ignore"):
        seed = mix64(element + U(cell + 1) * GOLDEN)
    u, mean = _uniform(seed), high - low
    number = np.zeros(len(seed), np.int64)
    term = cumulative = math.exp(-mean)
    for j in range(1, 40):
        more = u >= cumulative
        if not more.any():
            break
        number[more] = j
        term *= mean / j
        cumulative += term
    at = np.repeat(np.arange(len(seed)), number)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
    with np.errstate(over="ignore"):
        ident = mix64(seed[at] ^ (nth.astype(U) + U(1)) * M1)
        rank = low + mean * _uniform(mix64(ident + U(1)))
        weight = _uniform(mix64(ident + U(2)))
        coordinate = (mix64(ident + U(3)) % U(k)).astype(np.int64)
    keep = weight < last[at]
    at = at[keep]
    return owner[at], coordinate[keep], rank[keep], ident[keep]


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n rows of k dart identities for weighted elements; owner says whose they are (all weights > 0)."""
    total = np.bincount(owner, weight, n)
    units = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(owner)), units)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    with np.errstate(over="ignore"):
        region = mix64(element[at] + (nth.astype(U) + U(1)) * M2)
    share = np.minimum(1.0, weight[at] - nth)
    owner = owner[at]
    rank = np.full(n * k, np.inf)
    ident = np.zeros(n * k, U)
    limit = k * (math.log(k) + 2.5) / np.maximum(total, 1e-9)
    done, open_ = np.zeros(n), total > 0  # done: cells thrown so far
    while open_.any():
        cells = np.where(limit <= 1, 1 + np.searchsorted(EDGES[1:], limit), FINE + np.ceil(limit)).astype(np.int64)
        for c in range(int(cells[open_].max())):
            use = open_ & (done <= c) & (cells > c)
            sel = use[owner]
            if not sel.any():
                continue
            o, coord, r, i = _throw(owner[sel], region[sel], share[sel], c, k)
            slot = o * k + coord
            np.minimum.at(rank, slot, r)
            earliest = r == rank[slot]
            ident[slot[earliest]] = i[earliest]
        done = np.where(open_, np.maximum(done, cells), done)
        open_ = open_ & np.isinf(rank.reshape(n, k)).any(axis=1)
        limit = np.where(open_, 2 * limit, limit)
    return ident.reshape(n, k)


def _weighted(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(h, n), return_counts=True)


def sketch(texts: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Per text, given as word hashes (one at least): ``bands`` keys, and a byte of each coordinate."""
    sets = [_weighted(h, p.shingle) for h in texts]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    sig = signatures(owner, np.concatenate([s for s, _ in sets]), np.concatenate([c for _, c in sets]).astype(float), len(sets), p.bands * p.rows)
    cut = sig.reshape(len(sets), p.bands, p.rows)
    out = np.zeros((len(sets), p.bands), U)
    with np.errstate(over="ignore"):
        for i in range(p.rows):
            out = mix64(out + GOLDEN) ^ cut[:, :, i]
        return mix64(out + np.arange(1, p.bands + 1, dtype=U) * GOLDEN), (sig >> U(56)).astype(np.uint8)


def similarity(a: np.ndarray, b: np.ndarray, n: int) -> float:
    """Weighted Jaccard similarity of two texts' shingles, from their word hashes."""
    (x, cx), (y, cy) = _weighted(a, n), _weighted(b, n)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(cx[i], cy[j]).sum())
    every = int(cx.sum() + cy.sum()) - both
    return both / every if every else 0.0


def unit_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The shingles, a repeated one once per occurrence: set similarity of these is the weighted one."""
    s, c = _weighted(h, n)
    at = np.repeat(np.arange(len(s)), c)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(c) - c, c)
    with np.errstate(over="ignore"):
        return mix64(s[at] + nth.astype(U) * GOLDEN)


def _as_hashes(x) -> np.ndarray:  # noqa: ANN001
    return np.asarray(x, np.int64).view(U)


def _mark() -> Column:
    """What tells rows of one doc_id apart: a hash of the text as it is."""
    return F.xxhash64("text")


def signed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (doc_id, mark, key, n, bands, sig) of every document: a hash of its text, one of
    its words (null without any), the number of shingles, and the sketch."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), words(F.col("text")).alias("w"))
    key = F.when(F.size("w") > 0, F.unhex(F.md5(F.array_join("w", " ").cast("binary"))))
    hashed = split.select("doc_id", "mark", key.alias("key"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), p.texts):
                part = pdf.iloc[a : a + p.texts]
                hashes = [_as_hashes(x) for x in part["h"]]
                full = [i for i, h in enumerate(hashes) if len(h)]
                bands: list = [[]] * len(part)
                sigs: list = [b""] * len(part)
                if full:
                    keys, marks = sketch([hashes[i] for i in full], p)
                    for i, row, m in zip(full, keys.view(np.int64), marks, strict=True):
                        bands[i], sigs[i] = row, m.tobytes()
                n = [max(1, len(h) - p.shingle + 1) if len(h) else 0 for h in hashes]
                ids = part["doc_id"].astype("Int64").to_numpy()
                yield pd.DataFrame({"doc_id": ids, "mark": part["mark"].to_numpy(), "key": part["key"].to_numpy(), "n": n, "bands": bands, "sig": sigs})

    return hashed.mapInPandas(sign, "doc_id long, mark long, key binary, n int, bands array<long>, sig binary")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, comp) of the nodes of edges (a, b): the smallest node that each is linked to."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-both")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "neardup-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        root = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = materialize(step.join(root, "comp").select("node", "was", F.least("comp", "root").alias("comp")), "neardup-labels")
        if not new.where("comp < was").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def block_links(group: pd.DataFrame, p: Params) -> list[tuple[int, int]]:
    """Links that join the components of a block's members (node, comp, n, sig, units)."""
    nodes, n = group["node"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    _, comp = np.unique(group["comp"].to_numpy(np.int64), return_inverse=True)
    sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), -1)
    k = sig.shape[1]
    least = p.similarity - 5 * math.sqrt(p.similarity * (1 - p.similarity) / k)
    pairs: list[np.ndarray] = []
    for i in range(len(nodes) - 1):
        agree = (sig[i + 1 :] == sig[i]).sum(axis=1)
        small, large = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
        j = np.flatnonzero((agree >= least * k) & (comp[i + 1 :] != comp[i]) & (small >= p.similarity * large))
        if len(j):
            pairs.append(np.stack([agree[j], np.full(len(j), i), j + i + 1], axis=1))
    if not pairs:
        return []
    found = np.concatenate(pairs)
    found = found[np.argsort(-found[:, 0], kind="stable")]
    root, out = list(range(int(comp.max()) + 1)), []

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    units = [_as_hashes(x) for x in group["units"]]
    for _, i, j in found.tolist():
        a, b = top(comp[i]), top(comp[j])
        if a != b:
            same = len(np.intersect1d(units[i], units[j], assume_unique=True))
            if same >= p.similarity * (len(units[i]) + len(units[j]) - same):
                root[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _merge(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (node, comp) after the links (a, b)."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    merged = components(found.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    labels = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    return materialize(labels.select("node", F.coalesce("to", "comp").alias("comp")), "neardup-comp")


def links(nodes: DataFrame, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (node, comp) of the texts that share a bucket, from nodes (node, doc_id, mark, n, bands, sig)."""
    put = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    # sizes and leaders are written, so that Spark can split a large bucket in the joins with them
    sizes = materialize(put.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "neardup-sizes")
    buckets = materialize(put.join(sizes, "bucket"), "neardup-buckets")
    degree = buckets.groupBy("node").agg(F.sum("size").alias("degree"))
    members = materialize(buckets.join(degree, "node"), "neardup-members")
    candidates = members.select("node").distinct()

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), p.texts):
                part = pdf.iloc[a : a + p.texts]
                yield pd.DataFrame({"node": part["node"], "units": [np.sort(unit_hashes(_as_hashes(h), p.shingle)).view(np.int64) for h in part["h"]]})

    # shingles of the candidates alone, by one pass over the texts
    chosen = nodes.select("node", "mark", F.coalesce("doc_id", F.lit(NO_ID)).alias("_d")).join(candidates, "node", "left_semi")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), _mark().alias("mark"), "text")
    fetched = texts.join(chosen, ["mark", "_d"]).dropDuplicates(["mark", "_d"])
    shingles = materialize(fetched.select("node", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).mapInPandas(units, "node long, units array<long>"), "neardup-shingles")

    # every member with the most central one of its bucket
    first = F.max(F.struct("degree", (-F.col("node")).alias("minus"), "n")).alias("x")
    leader = members.groupBy("bucket").agg(first).select("bucket", (-F.col("x.minus")).alias("l"), F.col("x.n").alias("n_l"))
    leader = materialize(leader, "neardup-leaders")
    alike = (F.col("node") != F.col("l")) & (F.least("n", "n_l") >= p.similarity * F.greatest("n", "n_l"))
    pairs = members.join(leader, "bucket").where(alike).select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct()
    one, two = (shingles.select(F.col("node").alias(x), F.col("units").alias(f"u{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("same", F.size(F.array_intersect("ua", "ub")))
    stars = materialize(both.where(F.col("same") >= p.similarity * (F.size("ua") + F.size("ub") - F.col("same"))).select("a", "b"), "neardup-stars")
    labels = _merge(candidates.withColumn("comp", F.col("node")), stars)

    # buckets of three and more that still hold several components, each set of members once
    placed = members.where("size > 2").join(labels, "node")
    # components of buckets first, so that no bucket's members meet in one task
    same_set = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"set{i}") for i in range(2)]
    parts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("lead"), *same_set)
    whole = [F.bit_xor(f"set{i}").alias(f"set{i}") for i in range(2)]
    mixed = parts.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by(F.struct("comp", "m"), "lead").alias("main"), F.sum("m").alias("size"), *whole).where("low < high")
    once = mixed.groupBy("set0", "set1", "size").agg(F.min_by(F.struct("bucket", "main", "size"), "bucket").alias("x")).select("x.*")
    blocks = lambda n: F.ceil(n / p.block).alias("blocks")
    mixed = materialize(once.select("bucket", F.col("main.comp").alias("main"), blocks(F.col("main.m")).alias("mains"), blocks(F.col("size") - F.col("main.m")).alias("others")), "neardup-mixed")
    held = placed.drop("size").join(mixed, "bucket").withColumn("is_main", F.col("comp") == F.col("main"))
    at = F.when(F.col("is_main"), F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    meets = (
        F.when((F.col("mains") == 1) & (F.col("others") == 1), F.array(F.struct(F.lit("a").alias("kind"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))
        .when(F.col("is_main"), F.transform(upto("others"), lambda i: F.struct(F.lit("m").alias("kind"), i.alias("i"), F.col("at").alias("j"))))
        .otherwise(
            F.concat(
                F.transform(upto("others"), lambda j: F.struct(F.lit("o").alias("kind"), F.least(j, F.col("at")).alias("i"), F.greatest(j, F.col("at")).alias("j"))),
                F.transform(upto("mains"), lambda j: F.struct(F.lit("m").alias("kind"), F.col("at").alias("i"), j.alias("j"))),
            )
        )
    )
    dealt = held.withColumn("at", at).select("bucket", "node", "comp", "n", F.explode(meets).alias("g"))
    full = dealt.join(nodes.select("node", "sig"), "node").join(shingles, "node")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(group, p), columns=["a", "b"]).astype("int64")

    more = materialize(full.groupBy("bucket", "g").applyInPandas(settle, "a long, b long"), "neardup-more")
    return _merge(labels, more)


def classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (doc_id, mark, class_id, class_size, kept), one for each row of ``docs``."""
    rows = materialize(signed(docs, p), "neardup-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    by_text = rows.where("key is not null").groupBy("key").agg(first, F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    by_text = by_text.select("key", "first.doc_id", "first.mark", "copies", "n", "bands", "sig")
    nodes = materialize(by_text.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    labels = links(nodes, docs, p)
    named = nodes.select("node", "key", "doc_id", "mark", "copies").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = named.groupBy("comp").agg(first, F.sum("copies").alias("class_size"))
    of_text = named.select("comp", "key").join(groups, "comp").select("key", F.col("first.doc_id").alias("class_id"), F.col("first.mark").alias("class_mark"), "class_size")
    kept = F.col("key").isNull() | ((F.col("mark") == F.col("class_mark")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    out = rows.select("doc_id", "mark", "key").join(of_text, "key", "left")
    alone = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "mark", "key", alone.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), kept.alias("kept"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` without those whose class keeps another one."""
    keepers = classes(docs, p).where("kept and key is not null").select("mark", F.coalesce("doc_id", F.lit(NO_ID)).alias("_d")).distinct()
    blank = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))) == 0
    full, laid_out = carry(docs.where(~blank), (), _mark().alias("mark"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"))
    least = F.min_by(ROW, F.xxhash64(F.col(ROW).cast("string")))  # whatever the order of rows
    one = full.join(keepers, ["mark", "_d"]).groupBy("mark", "_d").agg(least.alias(ROW))
    return laid_out(one).unionByName(docs.where(blank))
