"""Fixed values and table schemas of the engine, in one place."""

from __future__ import annotations

from datetime import datetime
from enum import Enum

from pyspark.sql import types as T

from permitlake.errors import UnknownPurpose


class Purpose(str, Enum):
    """The closed vocabulary of purposes; a query names exactly one."""

    DIRECT_CARE = "direct_care"
    RESEARCH = "research"
    OUTREACH = "outreach"
    QUALITY_IMPROVEMENT = "quality_improvement"

    @classmethod
    def parse(cls, value: str | Purpose) -> Purpose:
        for p in cls:
            if value == p or value == p.value:
                return p
        raise UnknownPurpose(f"{value!r} is no purpose; there are {', '.join(p.value for p in cls)}")


#: Fixed values of the retrieval semantics.
DIMENSIONS = 1024
MIN_SIMILARITY = 0.55
PAGE_SIZE = 10
MAX_PAGES = 52
SMALL_CELL = 3
TOKEN = "[a-z0-9][a-z0-9\\-]*"
STRATUM_FIELDS = ("region", "condition", "doc_type")
STOP_WORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "by", "from", "is", "are", "was", "were", "be",
    "been", "and", "or", "that", "this", "these", "those", "it", "its", "as", "not", "no", "than", "then", "so", "such",
)

_text, _time = T.StringType(), T.TimestampType()
_texts = T.ArrayType(_text)

#: A ledger row: a permission, never changed once it is appended.
LEDGER = T.StructType(
    [
        T.StructField("subject", _text),
        T.StructField("purposes", _texts),
        T.StructField("scope", _texts),
        T.StructField("valid_from", _time),
        T.StructField("valid_until", _time),
        T.StructField("revoked_at", _time),
        T.StructField("version", T.IntegerType()),
    ]
)
DECISIONS = T.StructType(
    [T.StructField("at", _time), T.StructField("subject", _text), T.StructField("purpose", _text), T.StructField("version", T.IntegerType()), T.StructField("allowed", T.BooleanType())]
)
SPAN = T.StructType([T.StructField("kind", _text), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
DOCUMENT = T.StructType(
    [T.StructField(c, _text) for c in ("doc_id", "subject", "doc_type", "title", "text", "region", "condition")] + [T.StructField("identifiers", T.ArrayType(SPAN))]
)

#: The four files of a corpus.
SUBJECT_FILE = T.StructType([T.StructField(c, _text) for c in ("patient_id", "subject", "consent_state", "region", "condition")])
DOCUMENT_FILE = T.StructType(
    [T.StructField(c, _text) for c in ("doc_id", "patient_id", "doc_type", "title", "text")]
    + [T.StructField("identifiers", T.ArrayType(T.StructType([*SPAN.fields, T.StructField("surface", _text)]))), T.StructField("tokens", _texts)]
)
LEDGER_FILE = T.StructType(
    [T.StructField("subject", _text), T.StructField("purposes", _texts), T.StructField("scope", _texts), T.StructField("version", T.IntegerType())]
    + [T.StructField(c, _text) for c in ("valid_from", "valid_until", "revoked_at")]
)
MANIFEST_FILE = T.StructType(
    [
        T.StructField("now", _text),
        T.StructField("seed", T.LongType()),
        T.StructField("narrative_traps", T.ArrayType(T.StructType([T.StructField("doc_id", _text), T.StructField("patient_id", _text), T.StructField("span", T.ArrayType(T.IntegerType()))]))),
        T.StructField(
            "small_cells",
            T.ArrayType(T.StructType([T.StructField("stratum", _text), T.StructField("size", T.IntegerType()), T.StructField("members", _texts), T.StructField("non_consented", T.MapType(_text, _texts))])),
        ),
        T.StructField("oracle_pairs", T.ArrayType(T.StructType([T.StructField(c, _text) for c in ("present_token", "absent_token", "doc_id", "patient_id")]))),
    ]
)


def aware(when: datetime) -> datetime:
    """The instant itself; one without a time zone is refused."""
    if when.tzinfo is None:
        raise ValueError(f"{when} has no time zone")
    return when
