"""Corpus files: subjects, documents, permissions and manifest, as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.schemas import DOCUMENT_FILE, LEDGER, LEDGER_FILE, MANIFEST_FILE, SUBJECT_FILE
from permitlake.sources.ledger import Ledger

#: The files of a corpus folder.
FILES = {"subjects": "patients.json", "documents": "documents.json", "permissions": "consents.json", "manifest": "manifest.json"}


@dataclass(frozen=True)
class Corpus:
    subjects: DataFrame
    documents: DataFrame
    permissions: DataFrame
    manifest: DataFrame


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    """Reads a corpus folder with fixed schemas; a missing file raises FileNotFoundError."""

    def one(name: str, schema) -> DataFrame:  # noqa: ANN001
        file = f"{path.rstrip('/')}/{FILES[name]}"
        try:
            return spark.read.schema(schema).option("multiLine", True).json(file)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                raise FileNotFoundError(2, "no such corpus file", file) from error
            raise

    return Corpus(one("subjects", SUBJECT_FILE), one("documents", DOCUMENT_FILE), one("permissions", LEDGER_FILE), one("manifest", MANIFEST_FILE))


def permission_rows(permissions: DataFrame) -> DataFrame:
    """ISO texts as timestamps, in the ledger's columns."""
    times = {c: F.to_timestamp(c) for c in ("valid_from", "valid_until", "revoked_at")}
    return permissions.withColumns(times).withColumn("version", F.coalesce("version", F.lit(1))).select(*LEDGER.names)


def build(corpus: Corpus, path: str) -> tuple[Ledger, DataFrame]:
    """The ledger at ``path`` and the documents with their subjects' attributes, blank where unknown."""
    spark = corpus.documents.sparkSession
    ledger = Ledger(spark, path)
    ledger.append(permission_rows(corpus.permissions))
    who = corpus.subjects.select("patient_id", "region", "condition")
    docs = corpus.documents.join(who, "patient_id", "left").withColumnRenamed("patient_id", "subject")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("doc_type", "title", "region", "condition")}
    spans = F.transform("identifiers", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return ledger, docs.withColumns(blank).withColumn("identifiers", spans)


def upsert(log: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "seq") -> DataFrame:
    """Of an append log, the last whole row of each key: the last writer wins."""
    from pyspark.sql import Window as W

    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return log.withColumn("_rn", last).where("_rn = 1").drop("_rn")
