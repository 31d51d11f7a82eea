"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

The documents of a source, in an order drawn by hash, form blocks of
``block_docs``. A source with the weight w (of all weights' sum) gives its block
j the release time floor(j/w) and the deadline ceil((j+1)/w); taking, in each
slot, the released block with the earliest deadline meets every deadline, so
that after any number of slots a source has had its weight's share of blocks,
off by less than one. Weights are taken as exact fractions, so nothing adds up
over a long schedule, and every source has its own, however many there are.

The schedule is a table: one task takes the sources' sizes and writes the slots
in order, holding the sources only; the blocks of a bucket of documents then
find their slots by a join. That task's time grows with the number of blocks.

A source that has no block left ends a phase: its weight goes to the others in
proportion, and a new schedule starts. Every document is used exactly once.

Edge cases: null sources count as the source ''; a source without a weight gets
the smallest weight given; sources with the weight 0 follow, in equal shares,
when all others have run out; repeated rows are documents of their own; the last
block of a source may be smaller; an empty table mixes into an empty one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.llm.common import carry, materialize


@dataclass(frozen=True)
class Params:
    block_docs: int = 16
    period: int = 4096  #: slots that are written at a time
    bucket_rows: int = 2_000  #: documents of a source that are numbered together
    temperature: float = 0.5  #: default weights: sizes to this power


def default_weights(sizes: dict[str, int], temperature: float) -> dict[str, float]:
    return {s: float(n) ** temperature for s, n in sizes.items()}


def turns(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """The source and block of every slot, in order, by the exact weights."""
    left, done = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    exact = {s: Fraction(weights[s]) for s in left}
    while left:
        share = {s: exact[s] for s in left if exact[s] > 0} or dict.fromkeys(left, Fraction(1))
        scale = math.lcm(*(w.denominator for w in share.values()))
        k = {s: int(w * scale) for s, w in share.items()}
        total, t = sum(k.values()), 0
        waiting = [(0, s, 0) for s in k]
        heapq.heapify(waiting)
        ready: list[tuple[int, str, int]] = []
        while True:
            while waiting and waiting[0][0] <= t:
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // k[s]), s, j))
            _, s, j = heapq.heappop(ready)
            if not left[s]:
                break
            yield s, done[s]
            left[s] -= 1
            done[s] += 1
            t += 1
            heapq.heappush(waiting, ((j + 1) * total // k[s], s, j + 1))
        left = {s: n for s, n in left.items() if n}


def _schedule(totals: DataFrame, weights: dict[str, float] | None, p: Params) -> DataFrame:
    """Rows (_s, block, slot) for all blocks of sources (_s, n)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = {s: int(n) for pdf in batches for s, n in zip(pdf["_s"], pdf["n"], strict=True)}
        given = weights or default_weights(sizes, p.temperature)
        least = min(given.values(), default=1.0)
        order = turns({s: -(-n // p.block_docs) for s, n in sizes.items()}, {s: given.get(s, least) for s in sizes})
        at = 0
        while part := list(islice(order, p.period)):
            yield pd.DataFrame(part, columns=["_s", "block"]).assign(slot=np.arange(at, at + len(part)))
            at += len(part)

    return totals.repartition(1).mapInPandas(write, "_s string, block long, slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` with block, slot and place (in the block); order by slot, place.

    Columns of ``docs`` with those names are replaced.
    """
    source = F.coalesce("source", F.lit(""))
    buckets = max(1, -(-docs.count() // p.bucket_rows))
    h = F.xxhash64("doc_id", "text") if "text" in docs.columns else F.xxhash64("doc_id")
    keyed, laid_out = carry(docs, ("block", "slot", "place"), source.alias("_s"), h.alias("_h"), F.col("doc_id").alias("_id"))
    keyed = keyed.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    counts = keyed.groupBy("_s", "_b").agg(F.count("*").alias("n"))
    before = counts.withColumn("_o", F.sum("n").over(W.partitionBy("_s").orderBy("_b")) - F.col("n"))
    block_of = lambda r: F.floor(r / p.block_docs).cast("long")
    held = before.select("_s", "_b", "_o", F.explode(F.sequence(block_of(F.col("_o")), block_of(F.col("_o") + F.col("n") - 1))).alias("block"))
    slots = held.join(_schedule(counts.groupBy("_s").agg(F.sum("n").alias("n")), weights, p), ["_s", "block"])
    by_bucket = slots.groupBy("_s", "_b", "_o").agg(F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("_t"))
    found = materialize(by_bucket.withColumn("_t", F.transform("_t", lambda x: x.slot)), "mixing-slots")
    rank = F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", "_id")) - 1
    ranked = keyed.withColumn("_r", rank).join(found, ["_s", "_b"]).withColumn("_r", F.col("_r") + F.col("_o"))
    placed = ranked.withColumn("block", block_of(F.col("_r"))).withColumn("place", (F.col("_r") % p.block_docs).cast("int"))
    slot = F.get("_t", (F.col("block") - block_of(F.col("_o"))).cast("int"))
    return laid_out(placed.withColumn("slot", slot), "block", "slot", "place")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows in schedule order, cut into ranges of slots."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place")
