"""Candidate sets as bitmaps: 64 subjects in one row.

A set is rows (word, bits), optionally under key columns such as a purpose: bit
``subject & 63`` of word ``subject >> 6`` is set for a member. Only words with a
member have a row, so a set costs no more rows than members, and a 64th of them
where subjects are numbered densely. Union, intersection and difference are
bitwise operations on words of the same number; sizes are sums of bit counts.

Subjects are whole numbers of any sign; others are numbered first (for instance
by ``retrieval.ranked`` over the distinct subjects). Null subjects are in no set,
repeated ones count once, and a set without members has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a scan may be given by broadcast: some 64 bytes each in the hash table (estimated), so near 128 MB.
BROADCAST_WORDS = 2_000_000


def word(subject: str) -> Column:
    return F.shiftright(F.col(subject).cast("long"), 6)


def _bit(subject: str) -> Column:
    return F.expr(f"CAST(CAST(`{subject}` AS BIGINT) & 63 AS INT)")


def bitset(subjects: DataFrame, *keys: str) -> DataFrame:
    """The sets of ``subjects`` (keys, subject): rows (keys, word, bits).

    One aggregate of whole numbers, which combines before its shuffle: a task sends
    a word once, however many of its members it has.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    rows = subjects.where(F.col("subject").isNotNull()).select(*keys, word("subject").alias("word"), _bit("subject").alias("_bit"))
    return rows.groupBy(*keys, "word").agg(F.bit_or(bit).alias("bits"))


def members(bits: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, subject) of a set's members."""
    every = bits.select(*keys, "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_bit"))
    return every.where(F.call_function("bit_get", "bits", "_bit") == 1).select(*keys, (F.shiftleft("word", 6) + F.col("_bit")).alias("subject"))


def both(one: DataFrame, other: DataFrame) -> DataFrame:
    return _met(one, other, "inner", F.col("bits").bitwiseAND(F.col("_other")))


def without(one: DataFrame, other: DataFrame) -> DataFrame:
    return _met(one, other, "left", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_other", F.lit(0).cast("long")))))


def either(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _met(one: DataFrame, other: DataFrame, how: str, bits: Column) -> DataFrame:
    joined = one.join(other.select("word", F.col("bits").alias("_other")), "word", how)
    return joined.select("word", bits.alias("bits")).where("bits != 0")


def size(bits: Column) -> Column:
    """An aggregate: the members of the words it is taken over."""
    return F.coalesce(F.sum(F.bit_count(bits).cast("long")), F.lit(0).cast("long"))


def overlaps(sets: DataFrame, key: str, names: list[str]) -> DataFrame:
    """For each two of the named sets: rows (one, other, n_both, n_only, n_either), by one pass over the words.

    ``sets`` has (key, word, bits). A word of all sets is one row, so no set is
    joined with another: ``names`` is the fixed vocabulary that the columns come from.
    """
    side = {n: F.coalesce(F.bit_or(F.when(F.col(key) == n, F.col("bits"))), F.lit(0).cast("long")).alias(f"_{i}") for i, n in enumerate(names)}
    words = sets.groupBy("word").agg(*side.values())
    sums = []
    for i in range(len(names)):
        for j in range(len(names)):
            a, b = F.col(f"_{i}"), F.col(f"_{j}")
            for what, bits in (("both", a.bitwiseAND(b)), ("only", a.bitwiseAND(F.bitwise_not(b))), ("either", a.bitwiseOR(b))):
                sums.append(size(bits).alias(f"{what}_{i}_{j}"))
    row = words.agg(*sums)
    pairs = [F.struct(F.lit(a).alias("one"), F.lit(b).alias("other"), *(F.col(f"{w}_{i}_{j}").alias(f"n_{w}") for w in ("both", "only", "either"))) for i, a in enumerate(names) for j, b in enumerate(names)]
    return row.select(F.inline(F.array(*pairs)))


def restrict(docs: DataFrame, bits: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """The documents whose subject is in the set.

    The words are counted first. Up to ``most`` they go to every task, and documents
    outside the set leave in the scan's own stage, before any exchange. A larger set
    is joined by word, where adaptive execution splits words with very many documents.
    """
    held = bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    if bits.count() <= most:
        held = F.broadcast(held)
    inside = F.call_function("bit_get", F.col("_bits"), _bit("subject")) == 1
    return docs.join(held, (word("subject") == F.col("_word")) & inside).select(docs["*"])
