"""A deterministic synthetic corpus, generated by Spark at any size.

Everything follows from the seed and a row's number, so that the result is the
same under any partitioning. Invariants: six permission states in fixed shares;
``rare_cells`` cells of one to three subjects; per document one name, record
number, phone, e-mail and address, with exact offsets; stories in the prose
that overlap no identifier; tokens that one hidden subject's document holds,
each with a twin that none holds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2026-08-04T00:00:00+00:00"
#: States, and their shares of twenty subjects.
STATES = (("active_direct_care", 8), ("active_research", 3), ("expired", 2), ("revoked", 3), ("never", 3), ("future", 1))
CONDITIONS = ("asthma", "migraine", "anaemia", "gout", "eczema")
REGIONS = ("north", "south", "east", "west")
RARE = ("lupus", "sarcoidosis", "porphyria", "amyloidosis")
KINDS = ("progress_note", "letter", "summary", "referral", "imaging", "plan")
NAMES = ("Alda", "Bram", "Cleo", "Dara", "Edan", "Fenn", "Gisa", "Hale", "Iona", "Jory")
TRADES = ("bell founder", "falconer", "clock mender", "ferry pilot", "glass blower", "puppet maker")
PLACES = ("the salt pier", "the old mill lane", "the lantern hill", "the reed island", "the copper quay")
PROSE = ("follow up in clinic", "routine review of medication", "no new complaints today", "blood pressure was steady", "sleep has improved since spring", "advice on diet was given", "the family asked about travel")


@dataclass(frozen=True)
class Params:
    subjects: int = 200
    documents_per_subject: int = 5
    rare_cells: int = 20
    traps: int = 60
    oracle_pairs: int = 30
    seed: int = 20260804


@dataclass(frozen=True)
class Generated:
    subjects: DataFrame
    documents: DataFrame
    permissions: DataFrame
    manifest: dict[str, Any]


def _h(p: Params, *what: Any) -> Column:
    return F.xxhash64(F.lit(p.seed), *(w if isinstance(w, Column) else F.lit(w) for w in what))


def _pick(values: tuple[str, ...], h: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(h, F.lit(len(values))).cast("int"))


def _subjects(spark: SparkSession, p: Params) -> DataFrame:
    i = F.col("id")
    slot, state, upto = F.pmod(i * 7, F.lit(20)), F.lit(None), 0
    for name, share in STATES:
        state = F.when((slot >= upto) & (slot < upto + share), name).otherwise(state)
        upto += share
    sizes = [c % 3 + 1 for c in range(p.rare_cells)]
    cell, first = F.lit(None).cast("int"), 0
    for c, size in enumerate(sizes):
        cell = F.when((i >= first) & (i < first + size), c).otherwise(cell)
        first += size
    rare = F.concat(_pick(RARE, cell), F.lit("-"), cell.cast("string"))
    return spark.range(p.subjects).select(
        i.alias("i"),
        F.format_string("P%03d", i + 1).alias("patient_id"),
        state.alias("consent_state"),
        F.coalesce(F.when(cell.isNotNull(), _pick(REGIONS, _h(p, "region", i))), _pick(REGIONS, i)).alias("region"),
        F.when(cell.isNotNull(), rare).otherwise(_pick(CONDITIONS, F.floor(i / len(REGIONS)).cast("long"))).alias("condition"),
    )


def _permissions(subjects: DataFrame, p: Params) -> DataFrame:
    state, now = F.col("consent_state"), F.to_timestamp(F.lit(NOW))
    days = lambda low, span, what: F.make_dt_interval((F.lit(low) + F.pmod(_h(p, what, F.col("i")), F.lit(span))).cast("int"))
    begin = F.when(state == "future", now + days(10, 200, "from")).when(state == "expired", now - days(400, 200, "from")).otherwise(now - days(100, 500, "from"))
    until = F.when(state == "expired", now - days(1, 90, "until")).when(F.pmod(_h(p, "open", F.col("i")), F.lit(2)) == 0, begin + days(900, 300, "until"))
    revoked = F.when(state == "revoked", now - days(1, 60, "revoked"))
    purposes = F.when(state == "active_research", F.array(F.lit("research"))).otherwise(F.array(F.lit("direct_care"), F.lit("quality_improvement")))
    scope = F.when(F.pmod(_h(p, "scope", F.col("i")), F.lit(5)) == 0, F.array(F.lit(KINDS[0]))).otherwise(F.array().cast("array<string>"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return subjects.where(state != "never").select(
        F.col("patient_id").alias("subject"), purposes.alias("purposes"), scope.alias("scope"), F.when(state == "revoked", 2).otherwise(1).alias("version"), iso(begin).alias("valid_from"), iso(until).alias("valid_until"), iso(revoked).alias("revoked_at")
    )


def _documents(subjects: DataFrame, p: Params) -> DataFrame:
    per = p.documents_per_subject
    rows = subjects.select("*", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k")).withColumn("n", F.col("i") * per + F.col("k"))
    n, i = F.col("n"), F.col("i")
    name = F.concat(_pick(NAMES, _h(p, "name", i)), F.lit(" Q"), i.cast("string"), F.lit("field"))
    surfaces = {
        "name": name,
        "mrn": F.format_string("MRN-%07d", F.pmod(_h(p, "mrn", i), F.lit(9_000_000)) + 1_000_000),
        "phone": F.format_string("+44 20 %04d %05d", F.pmod(_h(p, "phone", i), F.lit(10_000)), i),
        "email": F.concat(F.lit("q"), i.cast("string"), F.lit("@post.example.org")),
        "address": F.concat((i + 1).cast("string"), F.lit(" Orchard Row")),
    }
    # hidden subjects carry the stories and the tokens, spread evenly
    is_hidden = F.col("consent_state") != "active_direct_care"
    rank = F.col("h")  # hidden documents by number
    trap = is_hidden & (rank < p.traps)
    story = F.concat(F.lit("Known as the "), _pick(TRADES, _h(p, "trade", n)), F.lit(" of "), _pick(PLACES, _h(p, "place", n)), F.lit(", who kept exactly "), (n + 2).cast("string"), F.lit(" geese. "))
    token = is_hidden & (rank >= p.traps) & (rank < p.traps + p.oracle_pairs)
    # of every twenty subjects the same residues are hidden, so that their rank is arithmetic
    secret_residues = [r for r in range(20) if r * 7 % 20 >= STATES[0][1]]
    before = [sum(x < r for x in secret_residues) for r in range(21)]
    hidden_subjects = p.subjects // 20 * len(secret_residues) + before[p.subjects % 20]
    j = F.floor(i / 20).cast("long") * len(secret_residues) + F.get(F.array(*map(F.lit, before)), (i % 20).cast("int"))
    numbered = rows.withColumn("h", F.when(is_hidden, F.col("k") * F.lit(hidden_subjects) + j))
    secret = F.concat(F.lit("zzkey-"), rank.cast("string"), F.lit("-"), F.substring(F.md5(_h(p, "token", n).cast("string").cast("binary")), 1, 6))
    kind = _pick(KINDS, _h(p, "kind", n))
    head = F.concat(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit("\n"))
    parts, spans, at = [head], [], F.length(head)
    for label, surface in surfaces.items():
        lead = F.lit(f"{label.capitalize()}: ")
        begin = at + F.length(lead)
        spans.append(F.struct(F.lit(label).alias("kind"), begin.cast("int").alias("start"), (begin + F.length(surface)).cast("int").alias("end"), surface.alias("surface")))
        parts += [lead, surface, F.lit("\n")]
        at = begin + F.length(surface) + 1
    record = F.concat(F.lit("Record type: "), kind, F.lit("\n\n"))
    at = at + F.length(record)
    prose = F.concat_ws(". ", *(_pick(PROSE, _h(p, f"prose{x}", n)) for x in range(4)))
    body = F.concat(F.when(trap, story).otherwise(F.lit("")), prose, F.when(token, F.concat(F.lit(" Ref "), secret)).otherwise(F.lit("")), F.lit("."))
    return numbered.select(
        F.format_string("D%04d", n + 1).alias("doc_id"),
        "patient_id",
        kind.alias("doc_type"),
        F.concat_ws(" - ", kind, "condition").alias("title"),
        F.concat(*parts, record, body).alias("text"),
        F.array(*spans).alias("identifiers"),
        F.when(token, F.array(secret)).otherwise(F.array().cast("array<string>")).alias("tokens"),
        F.when(trap, F.array(at.cast("int"), (at + F.length(story) - 1).cast("int"))).alias("span"),
    )


def generate(spark: SparkSession, p: Params = Params()) -> Generated:
    """The corpus as DataFrames; only the manifest, bounded by the parameters, is collected."""
    from permitlake.functions.text import stratum

    people = _subjects(spark, p)
    docs = _documents(people, p)
    traps = docs.where("span is not null").select("doc_id", "patient_id", "span").orderBy("doc_id").collect()
    pairs = docs.where(F.size("tokens") > 0).select("doc_id", "patient_id", F.col("tokens")[0].alias("t")).orderBy("doc_id").collect()
    cells = (
        people.withColumn("stratum", stratum(F.col("condition"), F.col("region")))
        .groupBy("stratum")
        .agg(F.count("*").alias("size"), F.sort_array(F.collect_list("patient_id")).alias("members"), F.sort_array(F.collect_list(F.when(F.col("consent_state") != "active_direct_care", F.col("patient_id")))).alias("hidden"))
        .where(F.col("size") <= 3)
        .orderBy("stratum")
        .collect()
    )
    manifest = {
        "now": NOW,
        "seed": p.seed,
        "narrative_traps": [{"doc_id": r["doc_id"], "patient_id": r["patient_id"], "span": list(r["span"])} for r in traps],
        "small_cells": [{"stratum": r["stratum"], "size": r["size"], "members": r["members"], "non_consented": {"direct_care": r["hidden"]}} for r in cells],
        "oracle_pairs": [{"present_token": r["t"], "absent_token": r["t"].replace("zzkey", "zznil"), "doc_id": r["doc_id"], "patient_id": r["patient_id"]} for r in pairs],
    }
    return Generated(people.withColumn("subject", F.col("patient_id")).drop("i"), docs.drop("span"), _permissions(people, p), manifest)


def write_corpus(made: Generated, folder: str) -> None:
    """Writes the four JSON files, byte for byte the same for the same parameters (fixture sizes)."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    frames = {"patients.json": (made.subjects, "patient_id"), "documents.json": (made.documents, "doc_id"), "consents.json": (made.permissions, "subject")}
    for name, (df, key) in frames.items():
        rows = [r.asDict(recursive=True) for r in df.orderBy(key).collect()]
        (root / name).write_text(json.dumps(rows, indent=2, sort_keys=True), encoding="utf-8")
    (root / "manifest.json").write_text(json.dumps(made.manifest, indent=2, sort_keys=True), encoding="utf-8")


def check(made: Generated) -> None:
    """Raises if an invariant doesn't hold."""
    docs = made.documents
    wrong = docs.where(F.exists("identifiers", lambda s: F.substring(F.col("text"), s.start + 1, s.end - s.start) != s.surface)).count()
    many = docs.where(F.size("identifiers") != 5).count()
    orphans = docs.join(made.subjects, "patient_id", "left_anti").count()
    granted = made.permissions.join(made.subjects.where("consent_state = 'never'"), made.permissions["subject"] == made.subjects["patient_id"], "left_semi").count()
    if wrong or many or orphans or granted:
        raise ValueError(f"corpus: {wrong} wrong offsets, {many} odd span counts, {orphans} orphans, {granted} grants that should not be")
