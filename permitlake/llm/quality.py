"""Quality rules by distribution divergence, in DataFrame functions only.

Per document: the base counts (words, symbols, repeated lines, words in
repeated 8-word windows), then the Jensen-Shannon distance of its character
classes and of its common words from the nearest language reference.

``fit`` gathers the references over all documents with a language: summed
character classes, and the frequencies of the ``common_words`` most frequent
words of each language (all classes are shared by all languages; every other
word is one further class). Every language has its reference; they grow with the
languages' square, 2 MB for 64 and 46 MB for 300 of them, and enter the plan as
one literal.

A document is kept unless the base rules fail it or a distance exceeds its
limit. That of the words is ``word_margin`` of the distance at which a text
without any common word lies from the nearest reference. Minimum-length guards: texts under ``min_chars`` characters or
``min_words`` words are not judged by the distance concerned.

Edge cases: a null text has no word and fails the base rules; without any
reference no distance is judged (they are null); ties between languages give
the same distance; repeated rows each get their own result. All work on a text
is linear in its length but for sorting its windows, and no row leaves its
partition except in the reference counts.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.llm.common import ROW, SPACE_RUN, carry, materialize, words

#: Character classes in the order in which they are taken out of a text.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", SPACE_RUN),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("symbol", "[#*$%&|<>]+"),
    ("punctuation", "[\\x21-\\x7E]+"),
    ("control", "[\\x00-\\x7F]+"),
)
N_CLASSES = len(CLASSES) + 1  # and whatever is beyond ASCII
WINDOW = 8


@dataclass(frozen=True)
class Params:
    common_words: int = 64  #: for each language
    min_words_base: int = 20
    repeat_percent: int = 30
    min_chars: int = 100
    min_words: int = 50
    char_limit: float = 0.25
    word_margin: float = 0.93


@dataclass(frozen=True)
class References:
    languages: tuple[str, ...]
    chars: tuple[tuple[float, ...], ...]  #: class frequencies of each language
    vocabulary: tuple[str, ...]
    words: tuple[tuple[float, ...], ...]  #: word frequencies, the last one all other words'


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _classes(text: Column) -> Column:
    """How many characters of each class a text holds."""
    left = [F.coalesce(text, F.lit(""))]
    for _, pattern in CLASSES:
        left.append(F.regexp_replace(left[-1], pattern, ""))
    sizes = [F.length(a) - F.length(b) for a, b in zip(left, left[1:], strict=False)]
    return F.array(*sizes, F.length(left[-1])).cast("array<long>")


def _plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w != "")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def fit(docs: DataFrame, p: Params = Params()) -> References:
    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    sizes = (
        rows.select("lang", _classes(F.col("text")).alias("c"))
        .groupBy("lang")
        .agg(F.count("*").alias("n"), *(F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(N_CLASSES)))
        .orderBy(F.desc("n"), "lang")
        .collect()
    )
    languages = tuple(r["lang"] for r in sizes)
    if not languages:
        return References((), (), (), ())
    shares = lambda counts: tuple((c + 0.5) / (sum(counts) + 0.5 * len(counts)) for c in counts)
    chars = tuple(shares([r[f"c{i}"] for i in range(N_CLASSES)]) for r in sizes)
    counts = materialize(
        rows.select("lang", F.explode(_plain_words(F.col("text"))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n")),
        "quality-words",
    )
    best = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= p.common_words)
    vocabulary = tuple(sorted(r["word"] for r in top.select("word").distinct().collect()))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    own = {(r["lang"], r["word"]): r["n"] for r in counts.where(F.col("word").isin(*vocabulary)).collect()} if vocabulary else {}
    word_rows = []
    for lang in languages:
        known = [own.get((lang, w), 0) for w in vocabulary]
        word_rows.append(shares([*known, totals.get(lang, 0) - sum(known)]))
    return References(languages, chars, vocabulary, tuple(word_rows))


def _divergence(terms: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of classes (i, p > 0) from a reference q > 0 over all classes."""

    def add(total: Column, x: Column) -> Column:
        q = F.get(reference, x.i)
        return total + x.p * F.log2(2 * x.p / (x.p + q)) + q * F.log2(2 * q / (x.p + q)) - q

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), add) / 2 + 0.5))


def word_limit(refs: References, p: Params = Params()) -> float:
    """The margin's share of the distance of a text without a common word; 1 without a reference."""
    alone = [math.sqrt(max(0.0, 0.5 + (math.log2(2 / (1 + q)) + q * math.log2(2 * q / (1 + q)) - q) / 2)) for *_, q in refs.words]
    return p.word_margin * min(alone, default=1 / p.word_margin)


def _table(values: object, kind: str) -> Column:
    """A literal of many values, as one; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _nearest(terms: Column, references: tuple[tuple[float, ...], ...]) -> Column:
    if not references:
        return F.lit(None).cast("double")
    return F.array_min(F.transform(_table(references, "array<array<double>>"), lambda r: _divergence(terms, r)))


def _char_terms(classes: Column) -> Column:
    every = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.filter(F.transform(classes, lambda n, i: F.struct(i.alias("i"), (n / every).alias("p"))), lambda x: x.p > 0)


def _word_terms(found: Column, vocabulary: tuple[str, ...]) -> Column:
    """(i, p) of each vocabulary word that occurs, and of all other words together."""
    n = F.size(found)
    common = F.sort_array(F.filter(found, lambda w: w.isin(*vocabulary)))

    def counted(c: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0))), lambda k: (k < F.size(c)) & F.coalesce(F.get(c, k) != F.get(c, k - 1), F.lit(True)))
        places = _table(vocabulary, "array<string>")
        known = _let(starts, lambda s: F.transform(s, lambda a, m: F.struct((F.array_position(places, F.get(c, a)) - 1).cast("int").alias("i"), ((F.coalesce(F.get(s, m + 1), F.size(c)) - a) / n).alias("p"))))
        other = F.array(F.struct(F.lit(len(vocabulary)).alias("i"), ((n - F.size(c)) / n).alias("p")))
        return F.concat(known, F.filter(other, lambda x: x.p > 0))

    return _let(common, counted)


def repeated_words(hashes: Column) -> Column:
    """How many words lie in 8-word windows that occur twice or more, from word hashes."""
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - WINDOW, F.lit(0))),
        lambda i: F.struct(F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))).alias("h"), i.alias("i")),
    )

    def covered(w: Column) -> Column:
        same = lambda s, x, k: F.coalesce(F.get(s, k).h == x.h, F.lit(False))
        twice = lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1))
        places = F.sort_array(F.transform(_let(F.sort_array(w), twice), lambda x: x.i))
        steps = _let(places, lambda q: F.transform(q, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - a, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def unlike(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(F.transform(w, lambda x: x.h))) < F.size(w), covered(w)).otherwise(F.lit(0))

    return F.when(F.size(hashes) > WINDOW, _let(windows, unlike)).otherwise(F.lit(0)).cast("long")


def judge(docs: DataFrame, refs: References, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` with the base counts, base_failed, char_distance, word_distance
    and kept; columns with those names are replaced."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
    held, laid_out = carry(docs, made, F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    split = held.select(ROW, "text", words(text).alias("_w"), _classes(text).alias("_c"), F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\x20\x09-\x0D]")).alias("_l"))
    name = {c: i for i, (c, _) in enumerate(CLASSES)}
    counted = split.select(
        ROW,
        "text",
        "_c",
        F.size("_w").cast("long").alias("n_words"),
        (F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("_c")[name["space"]]).alias("word_chars"),
        F.col("_c")[name["symbol"]].alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _let(F.transform("_w", lambda w: F.xxhash64(w)), repeated_words).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < p.min_words_base) | (100 * F.col("n_repeat_words") > p.repeat_percent * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    n_chars = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x)
    far = F.when(~F.col("base_failed") & (n_chars >= p.min_chars), _nearest_let(_char_terms(F.col("_c")), refs.chars))
    judged = judged.withColumn("char_distance", far)
    if refs.vocabulary:
        terms = _let(_plain_words(text), lambda w: F.when(F.size(w) >= p.min_words, _word_terms(w, refs.vocabulary)))
        word_far = F.when(~F.col("base_failed"), _let(terms, lambda t: F.when(t.isNotNull(), _nearest(t, refs.words))))
    else:
        word_far = F.lit(None).cast("double")
    judged = judged.withColumn("word_distance", word_far)
    within = lambda c, limit: F.coalesce(F.col(c) <= limit, F.lit(True))
    kept = ~F.col("base_failed") & within("char_distance", p.char_limit) & within("word_distance", word_limit(refs, p))
    return judged.withColumn("kept", kept).transform(laid_out, *made)


def _nearest_let(terms: Column, references: tuple[tuple[float, ...], ...]) -> Column:
    return _let(terms, lambda t: _nearest(t, references))
