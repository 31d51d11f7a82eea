"""Hashed bag-of-words vectors: normalised ones for retrieval, plain counts for the stored index."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.functions.text import query_terms, tokens
from permitlake.schemas import DIMENSIONS, STOP_WORDS, TOKEN


def bucket(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big") % DIMENSIONS


def query_vector(query: str) -> dict[int, float]:
    """The query's normalised vector, as its non-zero buckets."""
    out: dict[int, float] = {}
    for t in query_terms(query):
        out[bucket(t)] = out.get(bucket(t), 0.0) + 1.0
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {i: v / norm for i, v in sorted(out.items())}


def _embedded(found: list[str], known: dict[str, int]) -> np.ndarray:
    v = np.zeros(DIMENSIONS)
    for w in found:
        if w not in known:
            known[w] = bucket(w)
        v[known[w]] += 1.0
    norm = math.sqrt(float(v @ v))
    return (v / norm if norm else v).astype(np.float32)


def embed(text: Column) -> Column:
    """Normalised float vectors; the hash isn't a Catalyst function, so Arrow batches."""

    @F.pandas_udf("array<float>")
    def embedded(found: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        return found.map(lambda words: _embedded(words, known))

    return embedded(tokens(F.coalesce(text, F.lit(""))))


def cosine(vector: Column, query: dict[int, float]) -> Column:
    """The dot product of normalised vectors over the query's buckets alone: a few array
    accesses in generated code, whatever the dimension. A zero query scores 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.lit(0.0)) * v for i, v in query.items()), F.lit(0.0))


COUNTS_KEPT = 100_000  #: tokens whose buckets a task remembers
COUNTS_ROWS = 256  #: vectors that a task holds before they leave it


def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The counts of each text, in its order.

    What a Python worker holds has bounds, however large the corpus: the vectors of a
    few rows, not of an Arrow batch, and the buckets of so many tokens.
    """
    stops = dict.fromkeys(STOP_WORDS, DIMENSIONS)
    known: dict[str, int] = dict(stops)

    def one(text: str | None) -> np.ndarray:
        found = re.findall(TOKEN, text.lower()) if text else []
        if len(known) > COUNTS_KEPT:
            known.clear()
            known.update(stops)
        for w in (w for w in set(found) if w not in known):
            known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % DIMENSIONS
        return np.bincount([known[w] for w in found], minlength=DIMENSIONS + 1)[:DIMENSIONS].astype(np.int32)

    for texts in batches:
        for a in range(0, len(texts), COUNTS_ROWS):
            yield texts.iloc[a : a + COUNTS_ROWS].map(one)


def counted_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same from Arrow to Arrow: only the texts of a few rows become Python's, whatever a batch holds."""
    for part in counted(b.slice(a, COUNTS_ROWS).to_pandas() for b in batches for a in range(0, len(b), COUNTS_ROWS)):
        ends = np.arange(len(part) + 1, dtype=np.int32) * DIMENSIONS
        yield pa.ListArray.from_arrays(ends, np.concatenate(part.to_list()))


def counts(text: Column) -> Column:
    """Token counts in the md5 buckets (the digest's first 32 bits modulo DIMENSIONS), stop words left out.

    The index is made with it once for a corpus: no row leaves its task, and what an
    exploded count would shuffle stays in one array.
    """
    return F.arrow_udf(counted_arrays, "array<int>")(F.coalesce(text, F.lit("")))


def square(vec: Column) -> Column:
    """The sum of the squares of counts."""
    return F.aggregate(vec, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)


def entries(vec: Column) -> Column:
    """The buckets in use and their counts, as an array."""
    return F.filter(F.transform(vec, lambda x, i: F.struct(i.alias("bucket"), x.alias("weight"))), lambda e: e.weight > 0)


def dot(vec: Column, asked: Column) -> Column:
    """The inner product of a document's counts with a query's entries; whole numbers, so exact."""
    return F.aggregate(asked, F.lit(0).cast("long"), lambda a, e: a + F.get(vec, e.bucket).cast("long") * e.weight)


def ratio(inner: Column, n: Column, qn: Column) -> Column:
    """The cosine from an inner product and two sums of squares; null where one of these is 0."""
    return F.try_divide(inner, F.sqrt(n.cast("double")) * F.sqrt(qn.cast("double")))
