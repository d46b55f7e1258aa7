"""What models return: JSON with prose, fences, slips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY = 600


def stripped(raw: Column) -> Column:
    """Without thoughts and code fences."""
    c = F.regexp_replace(F.trim(raw), r"(?s)<think>.*?</think>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^```(?:json)?\s*", "")
    return F.regexp_replace(F.regexp_replace(c, r"\s*```$", ""), r"^\s+|\s+$", "")


def widest_object(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def parsed(raw: Column, schema: str) -> Column:
    """struct of ``schema``: the cleaned text, else its widest {…}; null where neither is an object."""
    c = stripped(raw)
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{"), F.from_json(x, schema))
    return F.coalesce(whole(c), whole(widest_object(c)))


def parse_error(raw: Column, schema: str) -> Column:
    return parsed(raw, schema).isNull()


def summary_fallback(raw: Column, field: Column) -> Column:
    """The parsed field, else the first 600 characters of the text."""
    return F.coalesce(field, F.substring(stripped(raw), 1, SUMMARY))


def lenient(text: Column, schema: str) -> Column:
    """JSON with trailing commas or raw line ends and tabs inside strings."""
    repaired = F.regexp_replace(text, r",\s*([}\]])", "$1")
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)), F.from_json(repaired, schema, {"allowUnquotedControlChars": "true"}))


SECTIONS = "struct<sections: array<struct<heading: string, body_md: string, image_refs: array<string>>>>"


def sections(raw: Column) -> Column:
    """array<struct<heading, body_md, image_refs array<int>>>: sections with heading and body, references that are digits only."""
    found = lenient(F.coalesce(widest_object(stripped(raw)), raw), SECTIONS)["sections"]
    good = F.filter(found, lambda s: (F.coalesce(s["heading"], F.lit("")) != "") & (F.coalesce(s["body_md"], F.lit("")) != ""))
    refs = lambda s: F.transform(F.filter(F.coalesce(s["image_refs"], F.array().cast("array<string>")), lambda r: r.rlike(r"^\d+$")), lambda r: r.cast("int"))
    return F.transform(good, lambda s: F.struct(s["heading"].alias("heading"), s["body_md"].alias("body_md"), refs(s).alias("image_refs")))


def no_sections(found: Column) -> Column:
    return F.coalesce(F.size(found), F.lit(0)) <= 0


def intent(raw: Column, allowed: list[str], default: str) -> Column:
    told = parsed(raw, "struct<intent: string>")["intent"]
    return F.when(told.isin(allowed), told).otherwise(default)


def sub_queries(raw: Column, query: Column, most: int = 3) -> Column:
    told = F.filter(parsed(raw, "struct<queries: array<string>>")["queries"], lambda q: F.coalesce(q, F.lit("")) != "")
    return F.when(F.size(told) > 0, F.slice(told, 1, most)).otherwise(F.array(query))


def judgement(raw: Column) -> Column:
    """struct<faithfulness, relevance, reason>; what does not parse is 0."""
    told = parsed(raw, "struct<faithfulness: string, relevance: string, reason: string>")
    number = lambda name: F.coalesce(told[name].try_cast("double"), F.lit(0.0)).alias(name)
    return F.struct(number("faithfulness"), number("relevance"), F.coalesce(told["reason"], F.lit("")).alias("reason"))
