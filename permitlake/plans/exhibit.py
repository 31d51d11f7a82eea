"""The exhibit: both configurations under all probes, the drill, the plans, and the report."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from permitlake.functions import decide, text, vectors
from permitlake.operators import drill, probes
from permitlake.operators.caches import CachedGate
from permitlake.operators.gates import ExclusionGate, MaskingGate
from permitlake.schemas import Purpose
from permitlake.sources.corpus import Corpus, build, read_corpus
from permitlake.sources.scratch import folder, written

PAGE_QUERIES = ["review", "routine", "follow up"]


@dataclass(frozen=True)
class Exhibit:
    masking: probes.ProbeResult
    exclusion: probes.ProbeResult
    drill: dict[str, Any]
    plan_exclusion: str
    plan_masking: str
    purpose: str
    when: str
    strategy: str
    counts: dict[str, int]


def trap_queries(corpus: Corpus) -> list[dict[str, Any]]:
    """Each story trap with the query that it makes, as long as its document is there."""
    traps = corpus.manifest.select(F.explode("narrative_traps").alias("t")).select("t.*")
    joined = traps.join(corpus.documents.select("doc_id", "text", "identifiers"), "doc_id")
    start, end = F.coalesce(F.get("span", F.lit(0)), F.lit(0)), F.coalesce(F.get("span", F.lit(1)), F.lit(120))
    made = joined.withColumn("query", text.story_query(F.col("text"), start, end, F.transform("identifiers", lambda s: s.surface)))
    return [r.asDict() for r in made.select("doc_id", "patient_id", "query").orderBy("doc_id").collect()]  # the manifest's traps


def run(spark: SparkSession, path: str, purpose: Purpose = Purpose.DIRECT_CARE, strategy: str = "pinned") -> Exhibit:
    corpus = read_corpus(spark, path)
    head = corpus.manifest.first().asDict(recursive=True)
    when = datetime.fromisoformat(head["now"])
    ledger, docs = build(corpus, folder(spark, "ledger"))
    docs = written(docs.withColumn("vec", vectors.embed(F.col("text"))), "exhibit-documents")
    manifest = head | {"narrative_traps": trap_queries(corpus)}
    people = corpus.subjects.select(F.col("patient_id").alias("subject"))
    allowed = written(ledger.consented(purpose, when), "exhibit-consented")  # as it is before the drill
    hidden = written(decide.hidden(people, allowed), "exhibit-hidden")
    exclusion, masking = ExclusionGate(ledger, docs, strategy=strategy), MaskingGate(ledger, docs)
    of_masking = probes.run_all(masking, manifest, purpose, when, hidden, PAGE_QUERIES)
    of_exclusion = probes.run_all(exclusion, manifest, purpose, when, hidden, PAGE_QUERIES)
    plans = [g.search("review", purpose=purpose, at=when).plan for g in (exclusion, masking)]
    subject = (allowed.orderBy("subject").first() or people.orderBy("subject").first())["subject"]
    own = docs.where(F.col("subject") == subject).orderBy("doc_id")
    story = own.select(text.drill_query(F.col("text")).alias("q"), text.stratum(F.col("condition"), F.col("region")).alias("s")).first()
    drilled = drill.run_drill(CachedGate(ExclusionGate(ledger, docs, strategy=strategy)), ledger, subject, story["q"] if story else "review", purpose, when, story["s"] if story else "")
    counts = {"subjects": people.count(), "documents": docs.count(), "consented_subjects": allowed.count(), "hidden_subjects": hidden.count()}
    return Exhibit(of_masking, of_exclusion, drilled.as_dict(), *plans, purpose.value, when.isoformat(), strategy, counts)


def outcome(x: Exhibit) -> str:
    """What the run shows: permissions leaked, it shows that they don't, or nothing (no baseline leak to compare with)."""
    return "leaked" if x.exclusion.leaks else "shown" if x.masking.leaks else "nothing"


def short_plan(plan: str, width: int = 160) -> str:
    """A plan for print: expression ids and plan ids away, long lines cut."""
    plain = re.sub(r"#\d+L?|, \[plan_id=\d+\]", "", plan)
    return "\n".join(x if len(x) <= width else x[: width - 3] + "..." for x in plain.splitlines())


def as_json(x: Exhibit) -> dict[str, Any]:
    def one(r: probes.ProbeResult) -> dict[str, Any]:
        return {"probes_run": r.probes_run, "total_leaks": len(r.leaks), "by_vector": r.by_vector(), "leaks": [vars(leak) for leak in r.leaks]}

    return {
        "purpose": x.purpose, "when": x.when, "engine": f"spark/{x.strategy}", "counts": x.counts, "masking": one(x.masking), "exclusion": one(x.exclusion),
        "revocation_drill": x.drill, "query_plan": {"exclusion": x.plan_exclusion, "masking": x.plan_masking},
    }


def markdown(x: Exhibit) -> str:
    m, e = x.masking, x.exclusion
    kinds = sorted({*m.by_vector(), *e.by_vector()})
    lines = [
        "# Permission as exclusion, against masking",
        "",
        f"{x.counts['subjects']} subjects, {x.counts['documents']} documents. For `{x.purpose}` at {x.when}, {x.counts['consented_subjects']} subjects are permitted and {x.counts['hidden_subjects']} are not.",
        "",
        "| | masking | exclusion |",
        "|---|---|---|",
        f"| probes run | {m.probes_run} | {e.probes_run} |",
        f"| **leaks** | **{len(m.leaks)}** | **{len(e.leaks)}** |",
        *(f"| {k} | {m.by_vector().get(k, 0)} | {e.by_vector().get(k, 0)} |" for k in kinds),
        "",
    ]
    for kind in kinds:
        found = [leak for leak in m.leaks if leak.vector == kind]
        lines += [f"## Leaks by {kind}: {len(found)} in the masking configuration", ""]
        for leak in found[:3]:
            lines += [f"> {leak.quote()}", "", f"subject `{leak.subject}`, `{leak.doc_id or leak.probe_id}`, by probe `{leak.probe_id}`", ""]
        if len(found) > 3:
            lines += [f"{len(found) - 3} more are in the JSON output.", ""]
    lines += ["## Plans", "", "Exclusion:", "```", short_plan(x.plan_exclusion), "```", "Masking:", "```", short_plan(x.plan_masking), "```", ""]
    d = x.drill
    lines += [f"## Revocation of `{d['subject']}`: all surfaces dark: {d['all_dark']}, slowest {d['worst_seconds']:.4f} s", "", "| surface | visible before | visible after | seconds to dark |", "|---|---|---|---|"]
    lines += [f"| {s['surface']} | {s['visible_before']} | {s['visible_after']} | {'-' if s['seconds_to_dark'] is None else s['seconds_to_dark']} |" for s in d["surfaces"]]
    lines += ["", "Not covered: timing as a channel, and published totals of the whole corpus."]
    return "\n".join(lines) + "\n"


def dump(x: Exhibit) -> str:
    return json.dumps(as_json(x), indent=2, ensure_ascii=False)
