"""Lenient parsing of model responses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)```"


def lenient_json(raw: Column, schema: str, array: bool = False) -> Column:
    """JSON as given, else in a fenced block, else the first object or array; null if none parses. For an array that is cut off, its complete objects."""
    shape = r"(?s)(\[.*\])" if array else r"(?s)(\{.*\})"
    tries = [F.trim(raw), F.trim(F.regexp_extract(raw, FENCE, 1)), F.regexp_extract(raw, shape, 1)]
    want = F.lit("[" if array else "{")
    parsed = [F.from_json(F.when(F.startswith(t, want), t), schema, {"mode": "PERMISSIVE"}) for t in tries]
    if array:
        whole = F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0))
        parsed = [F.when(F.size(p) > 0, p) for p in parsed]
        parsed.append(F.from_json(F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]")), schema))
    else:
        parsed = [F.when(F.to_json(p) != "{}", p) for p in parsed]
    return F.coalesce(*parsed)


def truth(text: Column) -> Column:
    """A boolean given as text."""
    return F.lower(F.trim(text)).isin("true", "yes", "1")


def tag_list(raw: Column, most: int = 5) -> Column:
    """A JSON array, a bracketed fragment, else parts between commas or blanks; trimmed, blanks dropped, the first few."""
    cut = F.split(F.regexp_replace(F.trim(raw), r"""[\[\]"'“”]""", ""), r"[,，、\s]+")
    got = F.coalesce(F.from_json(F.when(F.trim(raw).rlike(r"(?s)^\["), F.trim(raw)), "array<string>"), F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)(\[.*?\])", 1), F.lit("")), "array<string>"), cut)
    return F.slice(F.filter(F.transform(got, lambda t: F.trim(t)), lambda t: t != ""), 1, most)


def sub_queries(raw: Column, most: int = 4) -> Column:
    """A JSON array, a numbered list, or lines that all end in a question mark; else no sub-query."""
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.transform(F.filter(lines, lambda x: x.rlike(r"^\d+[.、)）]\s*\S")), lambda x: F.regexp_replace(x, r"^\d+[.、)）]\s*", ""))
    asked = F.when((F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike("[?？]$")), lines)
    got = F.coalesce(F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.lit("")), "array<string>"), F.when(F.size(numbered) > 1, numbered), asked, F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(got, lambda t: F.trim(t)), lambda t: t != ""), 1, most)


def should_retry(round_: Column, most: int, hallucinated: Column, cannot_answer: Column, top_score: Column, least: float = 0.3) -> Column:
    return (round_ < most) & (hallucinated | (cannot_answer & (top_score >= least)))
