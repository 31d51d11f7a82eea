"""Small hand-made worlds."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from permitlake.functions import vectors
from permitlake.schemas import DOCUMENT, Purpose
from permitlake.sources.ledger import Ledger
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
NOW = datetime(2026, 8, 4, tzinfo=timezone.utc)
DAY = timedelta(days=1)
CARE = Purpose.DIRECT_CARE


def docs(spark, rows):
    """(doc_id, subject, text[, condition[, identifiers]])"""
    full = [(d, s, "note", "", t, "Orkney", *(rest[:1] or ["Hypertension"]), rest[1] if len(rest) > 1 else []) for d, s, t, *rest in rows]
    return spark.createDataFrame(full, DOCUMENT).withColumn("vec", vectors.embed(F.col("text"))).persist()


def gate_world(spark, path):
    ledger = Ledger(spark, path)
    ledger.record("PA", [CARE], NOW - 100 * DAY)
    ledger.record("PB", [CARE], NOW - 100 * DAY, revoked_at=NOW - DAY)
    rows = [("D1", "PA", "Alpha note about hypertension."), ("D2", "PB", "Note ZZKEY-01-qxth here.", "Kessler"), ("D3", "PC", "Note ZZKEY-02-mfld here.", "Kessler")]
    rows += [(f"F{i:02d}", "PA", f"Follow up visit number {i} routine.") for i in range(30)]
    return ledger, docs(spark, rows)
