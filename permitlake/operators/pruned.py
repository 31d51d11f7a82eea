"""The best documents of a search without scoring all that match: dynamic pruning, exact.

A block's score is bounded by its block maxima; the blocks with the greatest
bounds are scored first, and the k-th best score so found is a threshold. Blocks
whose bound stays below it are never read again. Of the other blocks' documents,
the lists of the query's heaviest buckets give the inner product over those; what
the other buckets can add is bounded by the lengths of both remainders. Only
documents whose bound reaches the threshold are scored in full. Scores are worked
out by the same expression as without pruning, and bounds have a margin for
rounding, so the result is the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.functions import vectors
from permitlake.operators.candidates import Restricted, restrict
from permitlake.schemas import MIN_SIMILARITY
from permitlake.sources.postings import Postings, holding
from permitlake.sources.scratch import written

MARGIN = 1e-9
HEAVY = 0.98  #: share of the query's squared length that its heaviest buckets hold
FIRST_BLOCKS = 16


@dataclass(frozen=True)
class Found:
    best: DataFrame  #: doc_id, subject, score: the k best that match, in no order
    scored: DataFrame  #: the documents that were scored in full after the first blocks
    blocks: DataFrame  #: the blocks that were left
    threshold: float


def best(p: Postings, query: dict[int, int], candidates: Restricted, terms: list[str], k: int, threshold: float = MIN_SIMILARITY) -> Found:
    """The k best permitted documents that hold a term or have a score over the threshold.

    ``query`` has the counts of the asked text's buckets (1,024 at most).
    """
    spark = p.docs.sparkSession
    square = sum(w * w for w in query.values())
    length = math.sqrt(square) or 1.0
    asked = spark.createDataFrame(list(query.items()) or [(-1, 0)], "bucket int, asked long")
    numbers = lambda values: ", ".join(map(str, values))
    entries = F.expr(f"arrays_zip(array({numbers(query.keys() or [0])}), array({numbers(query.values() or [0])}))").cast("array<struct<bucket:int,weight:int>>")
    named = holding(p, terms).withColumn("named", F.lit(True))

    def scored(docs: DataFrame) -> DataFrame:
        score = F.coalesce(vectors.ratio(vectors.dot(F.col("vec"), entries), F.col("norm"), F.lit(square)), F.lit(0.0))
        return docs.select("doc_id", "subject", score.alias("score"))

    def matching(rows: DataFrame, reached: float) -> DataFrame:
        """Below the threshold, terms decide; above it they need not be looked at."""
        if reached > threshold + MARGIN:
            return rows.where(F.col("score") > threshold)
        return rows.join(named, "doc_id", "left").where(F.col("named") | (F.col("score") > threshold)).drop("named")

    lists = p.impacts.where(F.expr(f"bucket IN ({numbers(query or [-1])})")).join(F.broadcast(asked), "bucket")  # 1,024 rows at most
    bounds = p.docs.select("block").distinct().join(lists.groupBy("block").agg((F.sum(F.col("most") * F.col("asked")) / length).alias("bound")), "block", "left").na.fill(0.0, ["bound"])
    first = bounds.orderBy(F.desc("bound")).limit(FIRST_BLOCKS)
    begun = matching(scored(restrict(p.docs.join(F.broadcast(first.select("block")), "block"), candidates)), -1.0)  # a few blocks
    top = [r["score"] for r in begun.select("score").orderBy(F.desc("score")).limit(k).collect()]  # k numbers
    least = top[-1] - MARGIN if len(top) == k else -1.0

    left = F.broadcast(bounds.where(F.col("bound") >= least).select("block"))  # a row for 256 documents; the lists stay where they are
    heavy, held = {}, 0
    for b, w in sorted(query.items(), key=lambda x: (-x[1], x[0])):
        if held >= HEAVY * square:
            break
        heavy[b], held = w, held + w * w
    rest = math.sqrt(max(0, square - held))
    near = lists.where(F.expr(f"bucket IN ({numbers(heavy or [-1])})")).join(left, "block").select("asked", F.inline("entries"))
    partial = near.groupBy("doc_id").agg(F.sum(F.col("asked") * F.col("weight")).alias("inner"), F.sum(F.col("weight").cast("long") * F.col("weight")).alias("seen"))
    slim = restrict(p.docs.select("doc_id", "subject", "block", "norm").join(left, "block"), candidates).join(partial, "doc_id", "left").na.fill(0, ["inner", "seen"])
    bound = (F.col("inner") + rest * F.sqrt((F.col("norm") - F.col("seen")).cast("double"))) / (length * F.sqrt(F.greatest("norm", F.lit(1)).cast("double")))
    chosen = written(slim.where(bound >= least).select("doc_id", "block"), "chosen")
    near_docs = p.docs.join(F.broadcast(chosen.select("block").distinct()), "block", "left_semi")  # vectors of other blocks don't travel
    full = scored(near_docs.join(chosen, ["doc_id", "block"], "left_semi"))
    return Found(matching(full, least).orderBy(F.desc("score"), "doc_id").limit(k), full, left, least)
