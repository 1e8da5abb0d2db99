"""Recovery of JSON from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text, F.lit(" \n\t\r")), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def object_text(text: Column) -> Column:
    """From the first opening to the last closing brace, else the text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text)


def array_text(text: Column) -> Column:
    """The outermost array; one that breaks off is closed after its last whole object; else the unfenced text."""
    plain = unfenced(text)
    whole = F.nullif(F.regexp_extract(plain, r"(?s)\[.*\]", 0), F.lit(""))
    cut = F.nullif(F.regexp_extract(plain, r"(?s)\[.*\}", 0), F.lit(""))
    return F.coalesce(whole, _valid(F.concat(cut, F.lit("]"))), plain)


def recovered(text: Column, default: str) -> Column:
    """The whole text if it is JSON, else its outermost object, else its outermost array, else the default."""
    plain = unfenced(text)
    part = lambda pattern: _valid(F.nullif(F.regexp_extract(plain, pattern, 0), F.lit("")))
    return F.coalesce(_valid(F.nullif(plain, F.lit(""))), part(r"(?s)\{.*\}"), part(r"(?s)\[.*\]"), F.lit(default))


def tool_calls(text: Column) -> Column:
    """struct(entities, rest): entities asked for in [QUERY_KB]{...}[/QUERY_KB] calls, and the text without the calls."""
    call = r"(?s)\[QUERY_KB\]\s*(\{.*?\})\s*(?:\[/QUERY_KB\]|(?=\n|$))"
    asked = F.transform(F.regexp_extract_all(text, F.lit(call), 1), lambda j: F.get_json_object(j, "$.entity"))
    return F.struct(F.filter(asked, lambda e: F.coalesce(e, F.lit("")) != "").alias("entities"), F.trim(F.regexp_replace(text, call, ""), F.lit(" \n\t\r")).alias("rest"))


def aliases(text: Column) -> Column:
    """A JSON list of names, trimmed, once each; anything else is the empty list."""
    names = F.transform(F.from_json(text, "array<string>"), lambda x: F.trim(x))
    return F.coalesce(F.array_distinct(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")), F.array().cast("array<string>"))


def loose_text(value: Column) -> Column:
    """A JSON value of any kind as text: a list's items that say something by commas, null and text that is no JSON as '', an object as JSON text."""
    items = F.filter(F.from_json(value, "array<string>"), lambda x: F.coalesce(x, F.lit("")).isin("", "0", "0.0", "false", "[]", "{}") == F.lit(False))
    kind = F.substring(F.ltrim(value), 1, 1)
    text = F.when(kind == "[", F.array_join(items, ", ")).when(kind == '"', F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).when(F.trim(value) == "null", "").otherwise(F.trim(value))
    return F.when(F.try_parse_json(value).isNull(), "").otherwise(F.coalesce(text, F.lit("")))
