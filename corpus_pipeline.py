"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept and is written before the next one reads it. All but the last
return the columns of ``documents``.

Edge cases are those of the operators; extra columns pass through unchanged,
and an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.llm import mixing, neardup, packing, pii, toxicity
from permitlake.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents whose toxicity score reaches the threshold."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))  # so that no column is replaced
    return toxicity.score(whole, model).where(F.col("predicted") == 0).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return neardup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows."""
    found = pii.detect(docs.select("text", F.struct("*").alias("row")), pii.fit(docs))
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture, each once; files follow one another in it."""
    whole = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    return mixing.in_order(mixing.mix(whole)).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences that follow the order of the mixture, as it is stored."""
    layout = packing.pack(packing.pieces_in_order(docs))
    return layout.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage is expressible in SQL; tests hold the operators against brute-force versions, and each stage's effect on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
