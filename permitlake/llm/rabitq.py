"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Index (``fit``, ``encode``): a bounded sample gives the centroids of coarse
cells; every vector goes to its nearest one. What is left of it is scaled to
length 1 and rotated by a random orthogonal matrix; the signs, packed into
bytes, are its code. With it go two scalars: the length before scaling, and the
inner product of the scaled vector with its own code, which corrects estimates.

Search: the k-th distance of a query to the sampled rows is an upper bound of
its k-th distance to all. A cell takes part for a query unless triangle and
hyperplane bounds prove that none of its rows lies within that. So each row
travels once per block of the queries that need its cell, and cells only save
work: no row is missed for them. On vectors without clusters all cells take
part, and rows times queries / ``row_block`` copies of vectors are sent. In a
block, queries are quantized to ``planes`` bits a component, and the bits that
planes and codes share are counted; this gives unbiased estimates of all inner
products and, with ``epsilon``, bounds on their error. Only rows whose lower
distance bound reaches the k-th best distance so far are reranked with the
original vectors, in double precision. The k best of each block meet in one
top-k per query.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
values take no part, neither do rows without an id; only vectors of equal
dimension are compared (dimensions are expected to be few); equal distances
rank by smaller id; rows that repeat an id and a vector count once, of several
vectors of an id the nearest counts, and a row never finds rows of its own id;
a query with fewer than k candidates returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.llm.common import materialize


@dataclass(frozen=True)
class Params:
    k: int = 10
    epsilon: float = 2.8  #: error bound, in standard deviations of the estimate
    planes: int = 4  #: bits of a query's component
    seed: int = 20
    cell_rows: int = 8_192  #: rows per cell, until there are max_cells
    max_cells: int = 512
    cell_sample: int = 32  #: sampled rows per cell
    sample_values: int = 2_097_152  #: bound on the components sampled
    row_block: int = 65_536  #: larger cells are dealt into blocks of so many rows
    query_block: int = 65_536
    block_values: int = 4_194_304  #: bound on the components of a block
    tile: int = 1_024  #: rows, and half as many queries, whose estimates are held at once


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray
    sample: np.ndarray  #: rows of the table
    sample_id: np.ndarray  #: their ids, each once


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    v = vector
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, vector, dim) that take part."""
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return out.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    return np.maximum(0.0, np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T))


def closest(x: np.ndarray, centroids: np.ndarray, step: int = 4_096) -> np.ndarray:
    return np.concatenate([np.argmin(squares(x[a : a + step], centroids), axis=1) for a in range(0, len(x), step)])


def k_means(sample: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Centroids of n cells; one that no row is closest to stays where it is."""
    out = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        own = closest(sample, out)
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(out)
        np.add.at(total, own, sample)
        out[size > 0] = total[size > 0] / size[size > 0, None]
    return out


def fit(rows: DataFrame, p: Params = Params()) -> dict[int, Cells]:
    """The cells of each dimension, from a sample whose bounds are parameters."""
    out: dict[int, Cells] = {}
    for r in rows.groupBy("dim").count().collect():
        dim, n = r["dim"], r["count"]
        cells = min(p.max_cells, -(-n // p.cell_rows), max(1, p.sample_values // dim // 8))
        most = max(p.k + 1, min(cells * p.cell_sample, p.sample_values // dim))
        share = F.pmod(F.xxhash64("vec_id", "vector", F.lit(p.seed)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
        drawn = rows.where((F.col("dim") == dim) & share).select("vec_id", "vector").limit(2 * most).collect()
        by_id = {d["vec_id"]: d["vector"] for d in drawn}
        sample = np.array(list(by_id.values()), float).reshape(-1, dim)
        ids = np.array(list(by_id), np.int64)
        out[dim] = Cells(k_means(sample, min(cells, len(sample)), p.seed) if len(sample) else np.zeros((1, dim)), sample, ids)
    return out


def codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length from the centre (or from each row's own), and inner product with the own code."""
    y = x - centre
    length = np.sqrt(np.einsum("ij,ij->i", y, y))
    unit = (y / np.where(length > 0, length, 1)[:, None]) @ turn
    bits = unit > 0
    own = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), length, own


def encode(rows: DataFrame, cells: dict[int, Cells], p: Params = Params()) -> DataFrame:
    """The rows with cell, code (packed bits), length and own: the index, a row for every vector."""
    centroids = {dim: c.centroids for dim, c in cells.items()}

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                d = int(dim)
                turn = turns.setdefault(d, rotation(d, p.seed))
                x = np.stack(own["vector"].to_numpy()).astype(float)
                cell = closest(x, centroids[d])
                bits, length, inner = codes(x, centroids[d][cell], turn)
                yield own.assign(cell=cell, code=[b.tobytes() for b in bits], length=length, own=inner)

    return rows.mapInPandas(coded, "vec_id long, vector array<double>, dim int, cell int, code binary, length double, own double")


def needed(q: np.ndarray, q_id: np.ndarray, cells: Cells, radius: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """An upper bound of each query's k-th distance, and which cells may hold a row within it.

    ``radius`` holds each cell's largest length, or -1 where it has no row.
    """
    near = squares(q, cells.sample)
    near[cells.sample_id[None, :] == q_id[:, None]] = np.inf
    limit = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(q), np.inf)
    far = np.einsum("ij,ij->i", q, q) + (cells.sample**2).sum(axis=1).max(initial=0) + (cells.centroids**2).sum(axis=1).max()
    limit = np.sqrt(limit + 1e-9 * far)
    to_cell = squares(q, cells.centroids)
    home = to_cell.argmin(axis=1)
    apart = np.sqrt(squares(cells.centroids, cells.centroids))[home]
    plane = (to_cell - to_cell.min(axis=1)[:, None]) / np.where(apart > 0, 2 * apart, np.inf)
    low = np.maximum(np.sqrt(to_cell) - radius[None, :], plane)
    return limit, ~(low > limit[:, None] + 1e-6 * np.sqrt(far)[:, None]) & (radius >= 0)[None, :]


def probes(queries: DataFrame, cells: dict[int, Cells], radius: dict[int, np.ndarray], k: int) -> DataFrame:
    """The queries (vec_id, vector, dim), each once, with the bound of their k-th distance and the cells they need."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, group in pdf.groupby("q_dim"):
                for a in range(0, len(group), 256):
                    own = group.iloc[a : a + 256]
                    q = np.stack(own["query"].to_numpy()).astype(float)
                    limit, wanted = needed(q, own["query_id"].to_numpy(), cells[int(dim)], radius[int(dim)], k)
                    yield own.assign(upper=limit, cells=[np.nonzero(w)[0].astype(np.int32) for w in wanted])

    # names of their own: the two sides of the search come from one table
    once = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("dim").alias("q_dim")).dropDuplicates()
    return once.mapInPandas(probe, "query_id long, query array<double>, q_dim int, upper double, cells array<int>")


def _exact(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 16_384):
        d = x[i[a : a + 16_384]] - q[j[a : a + 16_384]]
        out[a : a + 16_384] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, filled up with zeros."""
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def quantize(unit: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (query, plane, word) of the components, their lowest value and step, their sum and the length of the error."""
    low = unit.min(axis=1)
    step = np.maximum((unit.max(axis=1) - low) / ((1 << planes) - 1), 1e-12)
    level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
    packed = np.stack([words(np.packbits((level >> b) & 1, axis=1)) for b in range(planes)], axis=1)
    rough = low[:, None] + step[:, None] * level
    return packed, low, step, rough.sum(axis=1), np.linalg.norm(unit - rough, axis=1)


def estimates(code: np.ndarray, own: np.ndarray, unit: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of coded rows with queries of length 1, from shared bits, and bounds on their error."""
    dim = unit.shape[1]
    packed, low, step, total, error = quantize(unit, p.planes)
    shared = np.zeros((len(code), len(unit)), np.int32)
    for b in reversed(range(p.planes)):
        shared <<= 1
        for w in range(code.shape[1]):
            shared += np.bitwise_count(code[:, w, None] & packed[None, :, b, w])
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    c = np.maximum(own, 1e-9)[:, None]
    dot = (2 * (step[None, :] * shared + low[None, :] * ones[:, None]) - total[None, :]) / np.sqrt(dim)
    spread = min(1.0, p.epsilon / np.sqrt(max(1, dim - 1)))  # 1 is the bound that always holds
    return dot / c, spread * np.sqrt(np.maximum(0.0, 1 - c * c) + error[None, :] ** 2 + (0 if spread < 1 else 2 * error[None, :])) / c


def _best(j: np.ndarray, i: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest ids i of each j, every id once; sorted by j, distance and id."""
    order = np.lexsort((d, i, j))
    j, i, d = j[order], i[order], d[order]
    first = np.r_[True, (j[1:] != j[:-1]) | (i[1:] != i[:-1])] if len(j) else np.zeros(0, bool)
    j, i, d = j[first], i[first], d[first]
    order = np.lexsort((i, d, j))
    j, i, d = j[order], i[order], d[order]
    keep = np.arange(len(j)) - np.searchsorted(j, j) < k
    return j[keep], i[keep], d[keep]


def block_search(x: np.ndarray, x_id: np.ndarray, bits: np.ndarray, length: np.ndarray, own: np.ndarray, q: np.ndarray, q_id: np.ndarray, upper: np.ndarray, centre: np.ndarray, turn: np.ndarray, p: Params) -> tuple[pd.DataFrame, int]:
    """The k nearest rows (query_id, vec_id, score) of each query within its upper bound, and how many pairs were reranked."""
    code, reranked, found = words(bits), 0, []
    for b in range(0, len(q), max(1, p.tile // 2)):
        some = slice(b, b + max(1, p.tile // 2))
        y = q[some] - centre
        q_len = np.sqrt(np.einsum("ij,ij->i", y, y))
        unit = (y / np.where(q_len > 0, q_len, 1)[:, None]) @ turn
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = upper[some].copy()
        for a in range(0, len(x), p.tile):
            rows = slice(a, a + p.tile)
            estimate, bound = estimates(code[rows], own[rows], unit, p)
            base = length[rows][:, None] ** 2 + q_len[None, :] ** 2
            low = base - 2 * length[rows][:, None] * q_len[None, :] * np.minimum(1.0, estimate + bound) - 1e-6 * (base + 1)
            done = np.zeros(low.shape, bool)
            for step in (0, 1):
                if step == 0:  # the most promising first, so that the limits are tight
                    n = min(len(low), p.k + 1)
                    i, j = np.argpartition(low, n - 1, axis=0)[:n].T.ravel(), np.repeat(np.arange(len(y)), n)
                    done[i, j] = True
                    near = ~(low[i, j] > limit[j] ** 2)
                    i, j = i[near], j[near]
                else:
                    i, j = np.nonzero(~(low > limit[None, :] ** 2) & ~done)
                other = x_id[a + i] != q_id[b + j]
                i, j = i[other], j[other]
                reranked += len(i)
                d = _exact(x, q, a + i, b + j)
                kept = _best(np.concatenate([kept[0], j]), np.concatenate([kept[1], x_id[a + i]]), np.concatenate([kept[2], d]), p.k)
                full = np.bincount(kept[0], minlength=len(y)) == p.k
                last = np.searchsorted(kept[0], np.arange(len(y)), side="right")[full] - 1
                limit[full] = np.minimum(limit[full], kept[2][last])
        found.append(pd.DataFrame({"query_id": q_id[b + kept[0]], "vec_id": kept[1], "score": kept[2]}))
    return pd.concat(found, ignore_index=True), reranked


def search(index: DataFrame, queries: DataFrame, cells: dict[int, Cells], p: Params = Params()) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows of the index for each query (vec_id, vector, dim)."""
    spark = index.sparkSession
    sizes = index.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("length").alias("radius")).collect()  # max_cells rows a dimension
    radius = {dim: np.full(len(c.centroids), -1.0) for dim, c in cells.items()}
    for r in sizes:
        radius[r["dim"]][r["cell"]] = r["radius"]
    asked = materialize(probes(queries, cells, radius, p.k), "rabitq-probes")
    wanted = {(r["q_dim"], r["cell"]): r["count"] for r in asked.select("q_dim", F.explode("cells").alias("cell")).groupBy("q_dim", "cell").count().collect()}
    blocks = lambda n, dim, most: max(1, -(-n // max(1, min(most, p.block_values // dim))))
    plan = [(r["dim"], r["cell"], blocks(r["n"], r["dim"], p.row_block), blocks(n, r["dim"], p.query_block)) for r in sizes if (n := wanted.get((r["dim"], r["cell"]), 0))]
    of_rows = F.broadcast(spark.createDataFrame(plan, "dim int, cell int, row_blocks int, query_blocks int"))
    of_queries = F.broadcast(spark.createDataFrame(plan, "q_dim int, q_cell int, row_blocks int, query_blocks int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(of_rows, ["dim", "cell"]).withColumn("rb", F.pmod(F.xxhash64("vec_id", "vector"), "row_blocks").cast("int")).withColumn("qb", each("query_blocks")).drop("row_blocks", "query_blocks")
    spread = asked.withColumn("q_cell", F.explode("cells")).drop("cells").join(of_queries, ["q_dim", "q_cell"])
    right = spread.withColumn("q_qb", F.pmod(F.xxhash64("query_id", "query"), "query_blocks").cast("int")).withColumn("q_rb", each("row_blocks")).drop("row_blocks", "query_blocks")

    def near(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wanted.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        rows = rows.sort_values("vec_id", kind="stable")
        dim, cell = int(rows["dim"].iloc[0]), int(rows["cell"].iloc[0])
        x, q = (np.stack(c.to_numpy()).astype(float) for c in (rows["vector"], wanted["query"]))
        bits = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        return block_search(x, rows["vec_id"].to_numpy(), bits, rows["length"].to_numpy(), rows["own"].to_numpy(), q, wanted["query_id"].to_numpy(), wanted["upper"].to_numpy(), centroids[dim][cell], rotation(dim, p.seed), p)[0]

    centroids = {dim: c.centroids for dim, c in cells.items()}
    pairs = left.groupBy("dim", "cell", "rb", "qb").cogroup(right.groupBy("q_dim", "q_cell", "q_rb", "q_qb")).applyInPandas(near, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    met = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """The k nearest rows for the rows of ``df`` that meet ``is_query`` (over vec_id)."""
    rows = vectors(df, id_col, vector_col)
    cells = fit(rows, p)
    index = materialize(encode(rows, cells, p), "rabitq-index")
    return search(index, index.where(is_query).select("vec_id", "vector", "dim"), cells, p)
