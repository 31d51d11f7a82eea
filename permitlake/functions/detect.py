"""Sensitive-pattern detection over a text column, and by column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pack, pattern name, regular expression, severity and action.
PATTERNS = (
    ("ai-engineering", "model-provider-key", r"(?:sk-[a-zA-Z0-9]{20,}|hf_[a-zA-Z0-9]{20,}|r8_[a-zA-Z0-9]{20,})", "critical", "block"),
    ("ai-engineering", "inference-endpoint-credential", r"(?:api[_-]?subscription[_-]?key|anthropic[_-]?auth[_-]?token|openai[_-]?api[_-]?key)\s*[:=]\s*['\"][^'\"]{12,}['\"]", "critical", "block"),
    ("ai-engineering", "registry-credential", r"(?:registry[_-]?password|docker[_-]?token|oci[_-]?secret)\s*[:=]\s*['\"][^'\"]{8,}['\"]", "critical", "block"),
    ("ai-engineering", "unpinned-checkpoint", r"(?:from_pretrained|ollama\s+pull|--model)\s+['\"]?[\w./-]+:latest", "medium", "warn"),
    ("ai-engineering", "prompt-with-secret", r"(?:system_prompt|messages|prompt)\s*[:=].{0,200}(?:password|secret|api[_-]?key)", "high", "warn"),
    ("e-commerce", "credit-card", r"\b(?:\d{4}[- ]?){3}\d{4}\b", "critical", "block"),
    ("fintech", "credit-card", r"\b(?:\d{4}[- ]?){3}\d{4}\b", "critical", "block"),
    ("fintech", "ssn-financial", r"\b\d{3}-\d{2}-\d{4}\b", "critical", "block"),
    ("generic", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", "critical", "block"),
    ("generic", "api-keys", r"(?:api[_-]?key|secret[_-]?key|access[_-]?token)\s*[:=]\s*['\"][a-zA-Z0-9]{16,}['\"]", "critical", "block"),
    ("generic", "email-bulk", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "low", "log"),
    ("healthcare", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", "critical", "block"),
    ("healthcare", "diagnosis-code", r"\b[A-Z]\d{2}\.\d{1,4}\b", "medium", "log"),
    ("saas", "api-keys", r"(?:api[_-]?key|secret|token)\s*[:=]\s*['\"][a-zA-Z0-9]{20,}['\"]", "critical", "block"),
)
#: Pack, name, severity and action of columns so named that hold sensitive data.
FIELDS = (
    ("e-commerce", "customer-email", "medium", "log", ("customer_email", "buyer_email")),
    ("fintech", "cvv", "critical", "block", ("cvv", "cvc", "cvv2", "security_code")),
    ("fintech", "account-number", "high", "warn", ("account_number", "accountNumber", "routing_number", "iban")),
    ("healthcare", "mrn", "high", "warn", ("mrn", "medical_record", "patient_id", "patientId")),
    ("healthcare", "dob", "high", "warn", ("date_of_birth", "dob", "birthDate", "birth_date")),
    ("saas", "cross-tenant-leak", "critical", "warn", ("tenant_id", "org_id", "workspace_id")),
    ("supply-chain", "pricing-data", "high", "warn", ("unit_cost", "wholesale_price", "margin", "cost_basis", "landed_cost")),
    ("supply-chain", "vendor-contracts", "medium", "log", ("contract_value", "contract_terms", "sla_penalty")),
    ("supply-chain", "trade-secrets", "critical", "block", ("formula", "recipe", "process_spec", "bom_secret")),
)
EMAIL = next(r for _, name, r, _, _ in PATTERNS if name == "email-bulk")
#: Text that a match of the pattern cannot do without, one of each tuple: a cheap test before the expression.
NEEDS = {
    "model-provider-key": ("sk-", "hf_", "r8_"),
    "inference-endpoint-credential": ("key", "token"),
    "registry-credential": ("password", "token", "secret"),
    "unpinned-checkpoint": (":latest",),
    "prompt-with-secret": ("messages", "prompt"),
    "ssn": ("-",),
    "ssn-financial": ("-",),
    "api-keys": ("key", "token", "secret"),
    "email-bulk": ("@",),
}


def found(text: Column, name: str, regex: str) -> Column:
    needs = NEEDS.get(name, ())
    quick = reduce(lambda a, b: a | b, (text.contains(x) for x in needs)) if needs else F.lit(True)
    return quick & text.rlike(regex)


def hits(docs: DataFrame) -> DataFrame:
    """Documents that match each pattern: one pass over the texts, each expression once, counts by partial aggregation."""
    own = {regex: i for i, regex in enumerate(dict.fromkeys(r for _, _, r, _, _ in PATTERNS))}
    name_of = {r: n for _, n, r, _, _ in PATTERNS}
    flags = [F.count_if(found(F.col("text"), name_of[r], r)).alias(f"p{i}") for r, i in own.items()]
    rows = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in (("pack", k), ("pattern", n), ("severity", s), ("action", a))), F.col(f"p{own[r]}").alias("documents")) for k, n, r, s, a in PATTERNS))
    return docs.agg(*flags).select(F.inline(rows))


def sensitive_columns(df: DataFrame) -> dict[str, tuple[str, str, str, str]]:
    """Columns whose names say that they are sensitive, with pack, name, severity and action."""
    return {c: (pack, name, severity, action) for c in df.columns for pack, name, severity, action, names in FIELDS if c in names}


def email_spans(text: Column) -> Column:
    """The mail addresses of a text as spans (kind, start, end), in order.

    Places come from the text between the matches, which a split by the same
    expression gives: the text of a match may also stand where none is.
    """
    kind = "array<struct<kind:string,start:int,end:int>>"
    matches = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    pairs = F.arrays_zip(F.split(text, EMAIL, -1).alias("gap"), matches.alias("match"))  # one gap more than matches
    start = F.named_struct(F.lit("at"), F.lit(0), F.lit("spans"), F.array().cast(kind))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["match"])
        span = F.named_struct(F.lit("kind"), F.lit("email"), F.lit("start"), begin, F.lit("end"), end)
        return F.named_struct(F.lit("at"), end, F.lit("spans"), F.array_append(acc["spans"], span))

    used = F.slice(pairs, F.lit(1), F.size(matches))
    return F.when(text.contains("@"), F.aggregate(used, start, add, lambda acc: acc["spans"])).otherwise(F.array().cast(kind))
