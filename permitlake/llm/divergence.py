"""Audit of sources: how far each source's words are from its language's and from other sources'.

Terms are runs of ASCII letters and of all characters beyond ASCII; only A to Z
are lower-cased. A language keeps the V terms that at least ``min_docs`` of its
documents hold. Every (lang, source) group and every language gives a kept term
with count c the integer ``p = 1 + floor(10^9 (c + 2) / (N + 2 V))``, N being its
count of all kept terms; two of them differ by ``f = floor((p - q)^2 / (p + q))``.
All of it is integer arithmetic (decimals where 64 bits could overflow).

* ``term``: the terms that a group uses more than its language, by f. f depends
  on nothing but the counts, so terms are grouped by (count in the group, count
  in the language), f is worked out once per cell, equal values are merged, and
  values are ranked by the cumulative number of terms. Only cells that reach the
  first ``top`` ranks are expanded into terms, in UTF-8 order.
* ``pair``: the sum of f over all kept terms for every two groups of a language.
  Terms that neither group has differ by a constant, so V times that constant is
  corrected by the terms that occur. Those are dealt over tasks by (lang, term
  hash, two blocks of at most ``source_block`` sources); a task adds up its
  terms, so that at most a number for each two sources leaves it.

Counting keeps no row per occurrence: each task counts its documents' terms in
tables of at most ``flush`` entries before they are shuffled, so a frequent term
or a hot source arrives as a few rows a task.

Edge cases: null text, lang and source are ''; a repeated row is a document of
its own; a language that keeps no term has V = 0, pairs of value 0 and no term
rows; a language with one source has no pairs; an empty table gives no rows.
Other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.llm.common import materialize

#: A term, as bytes of UTF-8 (all bytes over 0x7F belong to characters beyond ASCII).
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Params:
    min_docs: int = 10
    top: int = 10
    flush: int = 300_000  #: entries of a task's tables before they are handed on
    block_rows: int = 20_000
    source_block: int = 512
    cells: int = 2_000_000  #: numbers of a task's matrix


def count_terms(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences, and documents that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in seen.items():
                if n:
                    terms = pa.array(list(n), pa.binary()).cast(pa.string())
                    own = lambda v, k=len(n): pa.array([v] * k, pa.string())
                    yield pa.RecordBatch.from_arrays([own(lang), own(source), terms, pa.array(n.values(), pa.int64()), pa.array([held[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                found = TERM.findall(text.encode().lower())  # of bytes, only A to Z change
                n, held = seen.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                held.update(set(found))
                size += len(n)
                if size > p.flush:
                    yield from handed_on()
                    size = 0
        yield from handed_on()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*blank).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count; the numerator goes beyond 64 bits on large tables. Null where nothing is kept."""
    over = (count.cast("decimal(19,0)") + 2) * F.lit(UNIT)
    under = F.nullif(total + 2 * kept, F.lit(0)).cast("decimal(20,0)")
    return 1 + F.call_function("div", over, under)


def distance(a: Column, b: Column) -> Column:
    return F.call_function("div", (a - b) * (a - b), a + b)


@dataclass
class Counts:
    """``rows`` (lang, source, term, n, total) of kept terms, ``groups`` (lang, source, size, kept, lang_size, sid)."""

    rows: DataFrame
    groups: DataFrame


def gather(docs: DataFrame, p: Params = Params()) -> Counts:
    every = materialize(count_terms(docs, p), "divergence-counts")
    terms = every.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= p.min_docs).drop("docs")
    rows = materialize(every.drop("docs").join(terms, ["lang", "term"]), "divergence-kept")
    size = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = rows.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = names.join(size, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "kept", "lang_size"])
    groups = groups.withColumn("sid", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)  # a row per source
    return Counts(rows, materialize(groups, "divergence-groups"))


def top_terms(c: Counts, p: Params = Params()) -> DataFrame:
    """Rows (lang, source, item, value, rank) of each group's first terms."""
    group, own = ["lang", "source"], ["lang", "source", "n", "total"]
    cells = c.rows.groupBy(*own).agg(F.count("*").alias("m")).join(c.groups, group)
    here, there = share(F.col("n"), F.col("size"), F.col("kept")), share(F.col("total"), F.col("lang_size"), F.col("kept"))
    judged = cells.select(*own, "m", here.alias("p"), there.alias("q")).where("p > q").withColumn("value", distance(F.col("p"), F.col("q")))
    down = W.partitionBy(*group).orderBy(F.desc("value"))
    values = judged.groupBy(*group, "value").agg(F.sum("m").alias("m"))
    first = values.withColumn("at", F.row_number().over(down)).where(F.col("at") <= p.top)  # each value has a term at least
    reached = first.withColumn("before", F.sum("m").over(down) - F.col("m")).where(F.col("before") < p.top)
    chosen = judged.select(*own, "value").join(reached.select(*group, "value"), [*group, "value"])
    ranked = c.rows.join(chosen, own).withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("value"), "term")))
    return ranked.where(F.col("rank") <= p.top).select(*group, F.col("term").alias("item"), "value", "rank")


def _between(pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    d = pa_ - pb
    return d * d // (pa_ + pb)


def _gains(key: tuple, rows: pd.DataFrame, groups: pd.DataFrame, p: Params) -> pd.DataFrame:
    """For every two sources of two blocks, what the terms at hand add to the constant of absent ones."""
    lang, _, i, j = key
    groups = groups.sort_values("own")
    sids, blank, block = groups["own"].to_numpy(np.int64), groups["blank"].to_numpy(np.int64), groups["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    term, names = pd.factorize(rows["term"])
    at = np.searchsorted(sids, rows["sid"].to_numpy(np.int64))
    value, order = rows["p"].to_numpy(np.int64), np.argsort(term, kind="stable")
    term, at, value = term[order], at[order], value[order]
    gain = np.zeros((len(sids), len(sids)), np.int64)
    constant = _between(blank[:, None], blank[None, :])
    step = max(1, p.cells // max(1, len(sids)))
    for low in range(0, len(names), step):
        high = min(len(names), low + step)
        a, b = np.searchsorted(term, [low, high])
        matrix = np.repeat(blank[:, None], high - low, axis=1)
        matrix[at[a:b], term[a:b] - low] = value[a:b]
        for s in left:
            others = right[right > s]
            gain[s, others] += _between(matrix[s], matrix[others]).sum(axis=1) - (high - low) * constant[s, others]
    x, y = np.nonzero(gain)
    return pd.DataFrame({"lang": lang, "one": sids[x], "other": sids[y], "gain": gain[x, y]})


def pairs(c: Counts, p: Params = Params()) -> DataFrame:
    """Rows (lang, source, item, value, rank): each group beside each other source of its language."""
    groups = c.groups.withColumn("blank", share(F.lit(0), F.col("size"), F.col("kept"))).withColumn("block", F.floor(F.col("sid") / p.source_block).cast("int"))
    groups = groups.withColumn("blocks", F.max("block").over(W.partitionBy("lang")) + 1)
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    met = min(int(most), p.source_block) ** 2 // 2
    parts = max(1, -(-c.rows.count() // max(p.block_rows, met)))  # so that no more numbers leave the tasks than rows enter
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.named_struct(F.lit("i"), F.least(b, F.col("block")), F.lit("j"), F.greatest(b, F.col("block"))))
    dealt = c.rows.join(groups, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), F.inline(both), "term", "sid", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"))
    each = groups.where("kept > 0").select("lang", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "sid", "blank", "block", both.alias("met"))
    each = each.select("lang", "part", F.inline("met"), "sid", "blank", "block").toDF("lang2", "part2", "i2", "j2", "own", "blank", "block")
    key = ["lang", "part", "i", "j"]
    some = dealt.groupBy(*key).cogroup(each.groupBy("lang2", "part2", "i2", "j2")).applyInPandas(lambda k, rows, own: _gains(k, rows, own, p), "lang string, one int, other int, gain long")
    gains = some.groupBy("lang", "one", "other").agg(F.sum("gain").alias("gain"))
    seen = groups.select("lang", "source", "sid", "blank", "kept")
    beside = seen.select("lang", F.col("source").alias("item"), F.col("sid").alias("sid2"), F.col("blank").alias("blank2"))
    two = seen.join(beside, "lang").where("sid <> sid2").withColumns({"one": F.least("sid", "sid2"), "other": F.greatest("sid", "sid2")})
    constant = F.coalesce(F.col("kept") * distance(F.col("blank"), F.col("blank2")), F.lit(0))
    valued = two.join(gains, ["lang", "one", "other"], "left").withColumn("value", constant + F.coalesce("gain", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.select("lang", "source", "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of both parts."""
    c = gather(docs, p)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return part(pairs(c, p), "pair").unionByName(part(top_terms(c, p), "term"))
