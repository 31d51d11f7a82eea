"""Tokens, keyword predicates, masking and quotations, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.schemas import STOP_WORDS, TOKEN


def all_tokens(text: Column) -> Column:
    """Lower-case tokens, stop words and repeated ones kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case tokens without stop words, repeated ones kept."""
    return F.filter(all_tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def token_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """A row per token that is no stop word; dropping those after the explode stays in generated code."""
    return docs.select(*keys, F.explode(all_tokens(F.col("text"))).alias("token")).where(~F.col("token").isin(*STOP_WORDS))


def query_terms(query: str) -> list[str]:
    return [t for t in re.findall(TOKEN, query.lower()) if t not in STOP_WORDS]


def keyword_match(text: Column, terms: list[str]) -> Column:
    """Any term is a substring of the lower-cased text; false without terms."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(t) for t in dict.fromkeys(terms)), F.lit(False))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [KIND], from the last to the first."""
    ordered = F.array_sort(F.coalesce(spans, F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda a, b: b.start - a.start)
    return F.aggregate(ordered, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s.start), F.lit("["), F.upper(s.kind), F.lit("]"), F.substring(acc, s.end + 1, F.length(acc))))


def narrative(text: Column, header: str = "Record type:") -> Column:
    """What follows the line of the header's last field; the whole text without one."""
    at = F.locate(header, text)
    rest = F.substring(text, at, F.length(text))
    line = F.locate("\n", rest)
    body = F.when((at > 0) & (line > 0), F.substring(rest, line + 1, F.length(rest))).otherwise(text)
    return F.regexp_replace(body, "^\\s+|\\s+$", "")


def quote(evidence: Column, width: int = 220) -> Column:
    return F.translate(F.substring(evidence, 1, width), "\n", " ")


def story_query(text: Column, start: Column, end: Column, surfaces: Column, width: int = 120) -> Column:
    """The words of a span without the identifiers in it, squeezed and cut to a width."""
    phrase = F.substring(text, start + 1, end - start)
    bare = F.aggregate(F.coalesce(surfaces, F.array().cast("array<string>")), phrase, lambda acc, s: F.replace(acc, s, F.lit(" ")))
    return F.substring(F.trim(F.regexp_replace(bare, "\\s+", " ")), 1, width)


def drill_query(text: Column) -> Column:
    """The first four all-letter words, or ``review``."""
    found = F.slice(F.filter(F.split(text, "\\s+"), lambda w: w.rlike("^\\p{L}+$")), 1, 4)
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise("review")


def stratum(condition: Column, region: Column) -> Column:
    return F.concat(F.lit("cond="), F.coalesce(condition, F.lit("")), F.lit("|region="), F.coalesce(region, F.lit("")))
