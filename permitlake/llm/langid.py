"""Language identification: known words first, then ever shorter character n-grams.

Training (``fit``) learns from a bounded sample of labelled rows
(``rows_per_language``, drawn by a hash of the row): word counts and the counts
of the character n-grams of its words, both per language, counted in Spark and
cut to ``max_words`` and ``max_grams`` per language, the most frequent first.
Every labelled language is learned. The model is sparse: a key (the 64-bit hash
of a word or n-gram) has entries for the languages that know it only, some 25
bytes a key, so that 300 languages with all their words and n-grams take about
300 MB.

Scoring sums, over the words of the whole text, the smoothed log frequency of a
known word in each language; a word that no language knows takes the mean over
its n-grams of the greatest length at which any is known, from ``max_n`` down
to single characters. The language with the largest sum wins; the score is its
share of the posterior with the evidence tempered to at most ``temper`` words.

Edge cases: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language first in order; rows with null text or language train
nothing; without a training row every text is ``und``. Repeated rows change
nothing but their counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.llm.common import carry, materialize

WORD = re.compile(r"[^\W\d_]+")
FLUSH = 200_000
CELLS = 2_000_000  # words times languages whose values a task holds at once
PAIRS = 400_000  # words of texts that a task holds at once


@dataclass(frozen=True)
class Params:
    rows_per_language: int = 1_500  #: bound of the training sample
    max_words: int = 20_000
    max_grams: int = 20_000
    max_n: int = 5
    min_count: int = 2
    temper: int = 20


@dataclass(frozen=True)
class Model:
    """Entries of key i are start[i] to start[i + 1]; kind 0 is words, n is n-grams."""

    languages: tuple[str, ...]
    keys: np.ndarray  #: hashes of words, and of n-grams after a blank, in order
    kind: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray  #: log frequency above that of a key that the language doesn't know
    base: np.ndarray  #: log frequency of an unknown key, by kind and language
    max_n: int
    temper: int

    def size(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.kind, self.start, self.lang, self.gain, self.base))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word, keyed apart from words by a leading blank."""
    padded = f"<{word}>"
    return [f" {padded[i : i + n]}" for i in range(len(padded) - n + 1)]


def _hash(keys: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(keys, object), categorize=False) if keys else np.zeros(0, np.uint64)


def _sample(rows: DataFrame, params: Params) -> DataFrame:
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("_n")), "langid-sizes")  # small; Spark sees how small
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(sizes, "lang").where(part < params.rows_per_language / F.col("_n")).select("text", "lang")


def fit(rows: DataFrame, params: Params = Params()) -> Model:
    """Learns from the rows (text, lang) given."""
    rows = rows.select("text", "lang").where("text is not null and lang is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies: dict[str, Counter] = {}

        def out() -> pd.DataFrame:
            keys = []
            for lang, words in tallies.items():
                sums = Counter(words)
                for w, c in words.items():
                    for n in range(1, params.max_n + 1):
                        for g in grams(w, n):
                            sums[g] += c
                keys += [(lang, k, c) for k, c in sums.items()]
            tallies.clear()
            return pd.DataFrame(keys, columns=["lang", "key", "c"])

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                tallies.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
                if sum(map(len, tallies.values())) > FLUSH:
                    yield out()
        if tallies:
            yield out()

    counts = (
        _sample(rows, params)
        .mapInPandas(count, "lang string, key string, c long")
        .groupBy("lang", "key")
        .agg(F.sum("c").alias("c"))
        .withColumn("gram", F.col("key").startswith(" "))
        .where(F.col("c") >= params.min_count)
    )
    best = W.partitionBy("lang", "gram").orderBy(F.desc("c"), "key")
    most = F.when(F.col("gram"), params.max_grams).otherwise(params.max_words)
    best_ones = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= max(params.max_grams, params.max_words)).where(F.col("r") <= most)
    return model(best_ones.select("lang", "key", "c").toArrow().to_pandas(), params)


def model(found: pd.DataFrame, params: Params = Params()) -> Model:
    """The model of counts (lang, key, c)."""
    languages = tuple(sorted(found["lang"].unique()))
    at = {x: i for i, x in enumerate(languages)}
    lang = found["lang"].map(at).to_numpy(np.int64) if languages else np.zeros(0, np.int64)
    count = found["c"].to_numpy(float)
    kinds = np.where(found["key"].str.startswith(" "), found["key"].str.len() - 1, 0).astype(np.int64) if languages else np.zeros(0, np.int64)
    keys, first, back = np.unique(_hash(found["key"].tolist()), return_index=True, return_inverse=True)
    order = np.lexsort((lang, back))
    start = np.searchsorted(back[order], np.arange(len(keys) + 1))
    # words and each length of n-gram are distributions of their own
    kind = kinds[first].astype(np.int8)
    n, k = len(languages), params.max_n + 1
    total = np.bincount(kinds * n + lang, count, k * n).reshape(k, n) if n else np.zeros((k, 0))
    base = np.log(0.5 / (total + 0.5 * np.maximum(1, np.bincount(kind, minlength=k))[:, None]))
    return Model(languages, keys, kind, start.astype(np.int64), lang[order].astype(np.int32), np.log(2 * count[order] + 1).astype(np.float32), base, params.max_n, params.temper)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _known(m: Model, keys: list[str]) -> np.ndarray:
    """The place of each key in the model, -1 for none."""
    h = _hash(keys)
    i = np.minimum(np.searchsorted(m.keys, h), len(m.keys) - 1)
    return np.where(m.keys[i] == h, i, -1)


def word_rows(words: list[str], m: Model) -> np.ndarray:
    """A row of log frequencies for each word; zeros for one without a known n-gram."""
    owner, key, weight = [], [], []
    kind = np.full(len(words), -1)

    def take(who: np.ndarray, what: np.ndarray, w: np.ndarray, n: int) -> None:
        owner.append(who), key.append(what), weight.append(w)
        kind[who] = n

    i = _known(m, words)
    there = np.flatnonzero(i >= 0)
    take(there, i[there], np.ones(len(there)), 0)
    left = np.flatnonzero(i < 0)
    for n in range(m.max_n, 0, -1):
        if not len(left):
            break
        own = [grams(words[w], n) for w in left.tolist()]
        size = np.array([len(g) for g in own])
        i, who = _known(m, [g for x in own for g in x]), np.repeat(np.arange(len(left)), size)
        hits = np.bincount(who[i >= 0], minlength=len(left))
        ok = i >= 0
        take(left[who[ok]], i[ok], 1 / hits[who[ok]], n)
        left = left[hits == 0]
    who, what, w = (np.concatenate(x) for x in (owner, key, weight))
    size = m.start[what + 1] - m.start[what]
    at = _spread(m.start[what], size)
    n = len(m.languages)
    out = np.bincount(np.repeat(who, size) * n + m.lang[at], np.repeat(w, size) * m.gain[at], len(words) * n).astype(float).reshape(len(words), n)
    out[kind >= 0] += m.base[kind[kind >= 0]]
    return out


def _score(texts: list[list[str]], m: Model) -> list[tuple[str, float]]:
    """Languages and scores of texts, given as their words (one at least)."""
    size = np.array([len(x) for x in texts])
    word, every = pd.factorize(np.fromiter(chain.from_iterable(texts), object, int(size.sum())))
    by = np.argsort(word, kind="stable")
    text, word, every = np.repeat(np.arange(len(texts)), size)[by], word[by], every.tolist()
    n = len(m.languages)
    total = np.zeros((len(texts), n))
    step = max(1, CELLS // n)
    for a in range(0, len(every), step):
        rows = word_rows(every[a : a + step], m)
        first, last = np.searchsorted(word, [a, a + step])
        for b in range(first, last, step):
            own = slice(b, min(last, b + step))
            value = rows[word[own] - a]
            for k in range(n):
                total[:, k] += np.bincount(text[own], value[:, k], len(texts))
    mean = total / size[:, None] * np.minimum(size, m.temper)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    best = total.argmax(axis=1)
    return [(m.languages[i], float(x[i] / x.sum())) for i, x in zip(best.tolist(), p, strict=True)]


def scored(texts: Iterator[str | None], m: Model) -> list[tuple[str, float]]:
    """The language and score of each text."""
    out: list[tuple[str, float]] = []
    where: list[int] = []
    held: list[list[str]] = []
    n = 0

    def flush() -> None:
        if held:
            for i, x in zip(where, _score(held, m), strict=True):
                out[i] = x
        where.clear(), held.clear()

    for text in texts:
        out.append(("und", 0.0))
        found = WORD.findall(text.lower()) if text else []
        if found and m.languages and any(c.isalpha() for c in text):
            where.append(len(out) - 1), held.append(found)
            n += len(found)
            if n > PAIRS:
                flush()
                n = 0
    flush()
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score, which replace columns so named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams for a language

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(scored(texts, shared.value), columns=["lang_pred", "score"])

    out, laid_out = carry(docs, ("lang_pred", "score"), predicted("text").alias("p"))
    return laid_out(out, "p.lang_pred", "p.score")
