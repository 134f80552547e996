"""Strings: stream names, cases of names, patterns, templates, identifiers in headers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_name(aggregate_type: Column, aggregate_id: Column) -> Column:
    """Type-Id."""
    return F.concat_ws("-", aggregate_type, aggregate_id)


def stream_type(name: Column) -> Column:
    """What stands before the first hyphen; the whole name without one."""
    return F.substring_index(name, "-", 1)


def stream_id(name: Column) -> Column:
    """What stands after the first hyphen; the whole name without one."""
    at = F.instr(name, "-")
    return F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(name)


def snake_to_pascal(name: Column) -> Column:
    """order_placed -> OrderPlaced."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def pascal_to_snake(name: Column) -> Column:
    """OrderPlaced -> order_placed; a run of capitals is one word."""
    split = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(split)


def pascal_to_camel(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def handler_name(event_type: Column) -> Column:
    """The handler that takes events of a type: on_<snake case>."""
    return F.concat(F.lit("on_"), pascal_to_snake(event_type))


def glob(pattern: str) -> str:
    """A regular expression for a glob: ** crosses folders, * and ? do not."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    of = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(of.get(p, re.escape(p)) for p in parts) + "$"


def template(text: str, **values: Column) -> Column:
    """The text with {name} replaced by columns; a null becomes nothing."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def sanitized(name: Column) -> Column:
    """A name with all but letters, digits and underscores turned to underscores."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w.lower())) for w in words), F.lit(False))


def notice(value: Column) -> Column:
    """tenant:nonce as (tenant, nonce), split at the last colon; null if it isn't of that form."""
    ok = value.rlike("^.+:[0-9]+$")
    return F.when(ok, F.struct(F.regexp_extract(value, "^(.+):[0-9]+$", 1).alias("tenant_id"), F.regexp_extract(value, ":([0-9]+)$", 1).try_cast("bigint").alias("global_nonce")))


def traceparent(value: Column) -> Column:
    """A W3C trace header as (trace_id, span_id, sampled); null if malformed or all zero."""
    shape = "^([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    trace, span = F.regexp_extract(value, shape, 2), F.regexp_extract(value, shape, 3)
    ok = value.rlike(shape) & (F.regexp_extract(value, shape, 1) != "ff") & (trace != "0" * 32) & (span != "0" * 16)
    sampled = F.conv(F.regexp_extract(value, shape, 4), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1
    return F.when(ok, F.struct(trace.alias("trace_id"), span.alias("span_id"), sampled.alias("sampled")))


def version_number(version: Column) -> Column:
    """v3 -> 3, 2.1.0 -> 2; null for any other form."""
    simple = F.regexp_extract(version, "^v([0-9]+)$", 1)
    dotted = F.regexp_extract(version, r"^([0-9]+)\.[0-9]+\.[0-9]+$", 1)
    return F.coalesce(F.nullif(simple, F.lit("")), F.nullif(dotted, F.lit(""))).try_cast("int")
