"""Toxic passages as maximum-scoring segments of token log-odds.

Training (``fit``): token document frequencies of the toxic and the clean
class are counted in Spark; a Dirichlet prior in proportion to the pooled
frequencies smooths each class, and a token keeps its log-odds when its
z-score is large. The kept terms are a bounded model (``max_terms``).

Scoring (``score``): each token of a text scores its log-odds less a drift, so
that a clean text drifts down. A linear-time scan finds every maximal scoring
segment. By extreme-value statistics the best segment of a clean text of n tokens
exceeds s with the probability 1 - exp(-K n exp(-lambda s)): lambda is the root
that the clean token distribution gives, K the likeliest value for the upper
``tail`` of the best segments of the clean training rows. So a segment's score becomes
lambda s - log(K n), which is above zero where chance alone would hardly give
such a segment; the segments above zero are summed, and a two-parameter
calibration fitted on the training rows makes the sum a probability.

Edge cases: null and empty texts have no segment and get the score of a text
without evidence; rows whose label or text is null train nothing; with no
toxic or no clean training row every text scores exactly 0. Repeated rows count as
often as they occur. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import carry, held_out, materialize

TOKEN = re.compile(r"\w+")
FLUSH = 200_000


@dataclass(frozen=True)
class Params:
    prior: float = 200.0  #: weight of the Dirichlet prior, in documents
    min_z: float = 3.5  #: a kept term's z-score, at least
    min_docs: int = 4  #: documents that a kept term occurs in, at least
    max_terms: int = 100_000  #: bound of the model: terms kept, largest z first
    max_rows: int = 40_000  #: bound of the training sample
    drift: float = 0.35  #: taken from each token's score
    tail: float = 0.05  #: part of the clean rows whose best segments K is fitted to
    threshold: float = 0.3  #: predicted = 1 from this score on


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    drift: float
    lam: float  #: lambda of the extreme-value law
    log_k: float
    slope: float
    intercept: float


def _tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (token, toxic, clean); the empty token carries the number of rows."""
    sums: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pd.DataFrame:
        keys = list(sums[0].keys() | sums[1].keys())
        frame = pd.DataFrame({"token": keys, "toxic": [sums[1][k] for k in keys], "clean": [sums[0][k] for k in keys]})
        sums[0].clear()
        sums[1].clear()
        return frame

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            tokens = set(_tokens(text))
            tokens.add("")
            sums[int(toxic)].update(tokens)
            if len(sums[0]) + len(sums[1]) > FLUSH:
                yield out()
    if sums[0] or sums[1]:  # an empty frame has no column types
        yield out()


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum through it
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, left, total))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def passages(tokens: list[str], terms: dict[str, float], drift: float) -> list[tuple[int, int, float]]:
    """Maximal segments in token positions; runs without a kept term are one step down."""
    steps, where, last = [], [], 0
    for i, t in enumerate(tokens):
        s = terms.get(t)
        if s is None:
            continue
        if i > last:
            steps.append(-drift * (i - last))
            where.append((last, i))
        steps.append(s - drift)
        where.append((i, i + 1))
        last = i + 1
    return [(where[a][0], where[b - 1][1], s) for a, b, s in segments(steps)]


def evidence(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """The summed normalised score of significant passages, and those passages."""
    tokens = _tokens(text)
    if model.terms.keys().isdisjoint(tokens):
        return 0.0, []
    floor = model.log_k + math.log(len(tokens))
    found = [(a, b, model.lam * s - floor) for a, b, s in passages(tokens, model.terms, model.drift)]
    found = [x for x in found if x[2] > 0]
    return sum(x[2] for x in found), found


def _lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1."""
    if scores.max(initial=-1) <= 0:
        return 1.0
    f = lambda x: float(np.log(np.sum(weights * np.exp(np.clip(x * scores, -50, 50)))))
    low, high = 1e-4, 1e-4
    while f(high) <= 0 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) <= 0 else (low, mid)
    return max(low, 1e-3)


def best_passage(text: str | None, model: Model) -> tuple[int, float]:
    """The tokens of a text, and the score of its best segment (0 without one)."""
    tokens = _tokens(text)
    return len(tokens), max((s for _, _, s in passages(tokens, model.terms, model.drift)), default=0.0)


def _log_k(clean: DataFrame, model: Model, tail: float) -> float:
    """The log of the likeliest K under the law above, from the upper tail of clean texts' best
    segments, the rest being known to lie below it: rows in it by sum(n * exp(-lambda * best))."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([best_passage(t, model) for t in pdf["text"]], columns=["n", "s"])

    rows = materialize(clean.mapInPandas(best, "n long, s double").where("n > 0"), "toxicity-best")
    start = rows.agg(F.percentile("s", 1 - tail)).first()[0] or 0.0
    r = rows.agg(F.count_if(F.col("s") > start).alias("above"), F.sum(F.col("n") * F.exp(-model.lam * F.greatest("s", F.lit(start)))).alias("total")).first()
    return math.log(max(1, r["above"]) / r["total"]) if r["total"] else 0.0


def _platt(x: np.ndarray, y1: np.ndarray, y0: np.ndarray) -> tuple[float, float]:
    """Logistic slope and intercept for evidence x seen with y1 toxic and y0 clean rows."""
    a, b, n = 0.0, math.log((y1.sum() + 1) / (y0.sum() + 1)), y1 + y0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(x * (y1 - n * p)) - 1e-3 * a, np.sum(y1 - n * p)])
        w = n * p * (1 - p)
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w)]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(a)), float(b)


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Learns a model from the rows (text, toxic) given; null rows are left out."""
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where("text is not null and toxic in (0, 1)")
    counts = rows.mapInPandas(_count, "token string, toxic long, clean long").groupBy("token").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")
    )
    # min_docs leaves out what no z-score could keep; the row totals stay
    counts = counts.where((F.col("token") == "") | (F.col("t") + F.col("c") >= params.min_docs))
    n = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    n_t, n_c = int(n["t"] or 0), int(n["n"] - (n["t"] or 0))
    if not n_t or not n_c:
        return Model({}, params.drift, 1.0, 0.0, 0.0, -math.inf)
    a0, prior = params.prior, F.lit(params.prior) * (F.col("t") + F.col("c")) / (n_t + n_c)
    odds = F.log((F.col("t") + prior) / (n_t + a0 - F.col("t") - prior + 1)) - F.log((F.col("c") + prior) / (n_c + a0 - F.col("c") - prior + 1))
    z = odds / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    kept = (
        counts.where(F.col("token") != "")
        .select("token", "c", odds.alias("odds"), z.alias("z"))
        .where(F.abs("z") >= params.min_z)
        .orderBy(F.abs("z").desc(), "token")
        .limit(params.max_terms)
        .collect()
    )
    terms = {r["token"]: r["odds"] for r in kept}
    # clean token distribution: kept terms by their clean frequency, the rest at -drift
    per_doc = sum(r["c"] for r in kept) / n_c
    length = max(rows.where("toxic = 0").agg(F.avg(F.size(F.split("text", "\\s+")))).first()[0] or 1.0, per_doc + 1)
    scores = np.array([r["odds"] - params.drift for r in kept] + [-params.drift])
    weights = np.array([r["c"] / n_c / length for r in kept] + [1 - per_doc / length])
    model = Model(terms, params.drift, _lambda(scores, weights), 0.0, 0.0, 0.0)
    model = replace(model, log_k=_log_k(rows.where("toxic = 0"), model, params.tail))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [min(400, round(4 * math.sqrt(evidence(t, shared.value)[0]))) for t in pdf["text"]]
            yield pd.DataFrame({"x": x, "toxic": pdf["toxic"]}).groupby("x", as_index=False).agg(t=("toxic", "sum"), n=("toxic", "size"))

    fitted = rows.mapInPandas(bins, "x int, t long, n long").groupBy("x").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    x, t, m = (np.array([r[k] for r in fitted], float) for k in ("x", "t", "n"))
    slope, intercept = _platt(x / 4, t, m - t)
    return replace(model, slope=slope, intercept=intercept)


def probability(evidence: np.ndarray, m: Model) -> np.ndarray:
    """The calibrated score of summed normalised scores."""
    if m.intercept == -math.inf:
        return np.zeros(len(evidence))
    return 1 / (1 + np.exp(-np.clip(m.slope * np.sqrt(evidence) + m.intercept, -30, 30)))


def score(docs: DataFrame, model: Model, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` with score, predicted and passages (token spans).

    Columns of ``docs`` with those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_terms

    @F.pandas_udf("struct<score double, passages array<struct<start int, end int, score double>>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = [evidence(t, m) for t in texts]
        p = probability(np.array([e for e, _ in out], float), m)
        return pd.DataFrame({"score": p, "passages": [[{"start": a, "end": b, "score": s} for a, b, s in f] for _, f in out]})

    out, laid_out = carry(docs, ("score", "predicted", "passages"), scored("text").alias("s"))
    return laid_out(out, "s.score", (F.col("s.score") >= params.threshold).cast("int").alias("predicted"), "s.passages")


def training_rows(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows (text, toxic) of labelled documents outside the held-out fold.

    At most about ``max_rows`` of them, drawn by a hash of the id; so the
    labels are small enough to broadcast, and no text is shuffled. The rows are
    written once, as ``fit`` reads them several times.
    """
    marked = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
    n = marked.count()
    if n > params.max_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(params.max_rows / n * (1 << 30)))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return materialize(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "toxic"), "toxicity-rows")
