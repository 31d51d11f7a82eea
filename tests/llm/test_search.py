"""One-bit codes, against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from permitlake.llm import queries, rabitq
from pyspark.sql import functions as F
from worlds import DATA


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], "vec_id long, embedding array<float>")


def exact(vectors, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        out[q] = [int(i) for i in np.lexsort((np.arange(len(d)), d)) if i != q][:k]
    return out


def test_recall_and_distances(spark):
    x = np.random.default_rng(3).standard_normal((1500, 48)).astype(np.float32)
    p = rabitq.Params(row_block=400, query_block=7, tile=128)
    got = rabitq.nearest(table(spark, x.tolist()), F.col("vec_id") % 100 == 0, p=p).orderBy("query_id", "rank").collect()
    want = exact(x.astype(float), range(0, 1500, 100), 10)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - np.linalg.norm(x[r["query_id"]].astype(float) - x[r["vec_id"]].astype(float))) < 1e-12
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.98


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64))
    centre, turn = x.mean(axis=0), rabitq.rotation(64, 5)
    bits, _, own = rabitq.codes(x, centre, turn)
    assert bits.shape == (4000, 8)
    unit = (x - centre) / np.linalg.norm(x - centre, axis=1)[:, None]
    q = unit[0]
    estimate, bound = (v[1:, 0] for v in rabitq.estimates(rabitq.words(bits), own, (q @ turn)[None, :], rabitq.Params()))
    error = estimate - unit[1:] @ q
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound).mean() > 0.98


def test_few_rows_ties_and_odd_vectors(spark):
    rows = [[1, 0], [1, 0], [0, 1], None, [0, 0], [float("nan"), 1], [None, 1], [1, 1, 1], []]
    got = rabitq.nearest(table(spark, rows), F.lit(True)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    again = rabitq.nearest(table(spark, rows[:3] * 2, [0, 1, 2] * 2), F.lit(True)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in again] == [(r["query_id"], r["vec_id"]) for r in got]
    assert rabitq.nearest(table(spark, []), F.lit(True)).count() == 0


def test_many_equal_vectors(spark):
    got = rabitq.nearest(table(spark, [[0.5, 0.25]] * 300), F.col("vec_id") == 40, p=rabitq.Params(row_block=64)).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and all(r["score"] == 0 for r in got)


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_shared_bits_are_the_inner_product_of_quantized_queries(dim):
    rng = np.random.default_rng(dim)
    x, q = rng.standard_normal((30, dim)), rng.standard_normal((9, dim))
    q /= np.linalg.norm(q, axis=1)[:, None]
    bits, _, own = rabitq.codes(x, np.zeros(dim), np.eye(dim))
    packed, low, step, _, error = rabitq.quantize(q, 4)
    levels = np.rint((q - low[:, None]) / step[:, None])
    rough = low[:, None] + step[:, None] * levels
    sign = np.unpackbits(bits, axis=1, count=dim) * 2.0 - 1
    want = sign @ rough.T / np.sqrt(dim) / own[:, None]
    got, bound = rabitq.estimates(rabitq.words(bits), own, q, rabitq.Params())
    assert packed.shape == (9, 4, -(-dim // 64)) and np.allclose(got, want) and np.allclose(error, np.linalg.norm(q - rough, axis=1))
    if dim <= 8:  # the bound that always holds
        assert (np.abs(got - (x / np.linalg.norm(x, axis=1)[:, None]) @ q.T) <= bound + 1e-9).all()


def clusters(n, dim, parts, seed=8):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((parts, dim))[rng.integers(0, parts, n)] * 5 + rng.standard_normal((n, dim)) * 0.1


@pytest.mark.parametrize("parts", [1, 12])
def test_cells_left_out_hold_no_near_row(parts):
    x = clusters(3000, 16, parts)
    centroids = rabitq.k_means(x[:600], 12, 1)
    own = rabitq.closest(x, centroids)
    length = np.linalg.norm(x - centroids[own], axis=1)
    radius = np.array([length[own == c].max(initial=-1) for c in range(12)])
    cells = rabitq.Cells(centroids, x[:600], np.arange(600))
    limit, wanted = rabitq.needed(x[::50], np.arange(0, 3000, 50), cells, radius, 10)
    for row, q in enumerate(range(0, 3000, 50)):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        near = np.argsort(d)[:10]
        assert d[near].max() <= limit[row] and wanted[row][own[near]].all()
    assert parts == 1 or wanted.mean() < 0.3


def test_cells_blocks_and_repeated_ids(spark):
    x = clusters(900, 8, 6)
    ids = [i // 2 if i < 200 else i for i in range(900)]  # two vectors of an id
    p = rabitq.Params(cell_rows=100, row_block=37, query_block=5, tile=16)
    rows = table(spark, x.tolist() + x[:50].tolist(), ids + ids[:50])
    got = rabitq.nearest(rows, F.col("vec_id") % 20 == 0, p=p).orderBy("query_id", "rank").collect()
    vec, own = np.array(x, np.float32).astype(float), np.array(ids)
    right = total = 0
    for q in sorted({i for i in ids if i % 20 == 0}):
        d = np.min([np.linalg.norm(vec - v, axis=1) for v in vec[own == q]], axis=0)
        best = {}
        for i, one in zip(ids, d, strict=True):
            if i != q:
                best[i] = min(one, best.get(i, np.inf))
        want = sorted(best, key=lambda i: (best[i], i))[:10]
        mine = [r["vec_id"] for r in got if r["query_id"] == q]
        assert len(mine) == len(set(mine)) == 10
        right, total = right + len(set(mine) & set(want)), total + 10
    assert right / total >= 0.98


@pytest.mark.parametrize("folder", [DATA, DATA.replace("sf0.001", "sf0.1")])
def test_query_recall_on_the_given_table(spark, folder):
    t = pq.read_table(f"{folder}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.stack(t["embedding"].to_numpy(zero_copy_only=False)).astype(float)
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    got = {}
    for r in queries.op1_rabitq(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [int(i) for i in np.nonzero(ids % 100 == 0)[0]]
    want = {int(ids[q]): {int(ids[i]) for i in near} for q, near in exact(x, asked, 10).items()}
    assert got.keys() == want.keys()
    assert sum(len(got[q] & want[q]) for q in want) / (10 * len(want)) >= 0.97


def test_extra_columns_that_clash(spark):
    rows = table(spark, [[1, 0], [0, 1], [1, 1]]).withColumns({c: F.lit("x") for c in ("vector", "dim", "cell", "query_id", "rank", "score", "code")})
    assert rabitq.nearest(rows, F.col("vec_id") == 0).orderBy("rank").select("vec_id").collect() == [(2,), (1,)]
