"""Absent values, times, JSON, hashes, comparison of structures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """A string, null if empty."""
    return F.nullif(value, F.lit(""))


def or_else(value: Column, default: Column | str) -> Column:
    """A string, or the default if it is null or empty."""
    return F.coalesce(present(value), F.lit(default) if isinstance(default, str) else default)


def at_ms(ms: Column) -> Column:
    """Milliseconds as a timestamp; 0 is absent."""
    return F.timestamp_millis(F.nullif(ms, F.lit(0).cast("bigint")))


def ms_of(ts: Column) -> Column:
    """Milliseconds of a timestamp, rounded down; null becomes 0."""
    return F.coalesce(F.unix_millis(ts.cast("timestamp")), F.lit(0).cast("bigint"))


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def saturating_minus(a: Column, b: Column | int) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), a - b)


def backoff_ms(attempt: Column, initial: int = 100, multiplier: float = 2.0, most: int = 30_000) -> Column:
    """Delay before an attempt (from 1): initial * multiplier^(attempt - 1), at most `most`."""
    return F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(multiplier), attempt - 1)).cast("bigint")


def sorted_map(m: Column) -> Column:
    """A map as text with sorted keys, the same for equal maps."""
    entries = F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(entries))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of values, each with its length, so that no two different lists agree."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *(F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts)), 256)


def matches_partially(actual: Column, expected: dict) -> Column:
    """Whether a struct has the expected fields: nested dicts likewise, lists as a beginning of the array."""
    found = F.lit(True)
    for key, want in expected.items():
        have = actual[key]
        if isinstance(want, dict):
            found &= matches_partially(have, want)
        elif isinstance(want, list):
            found &= F.slice(have, 1, max(1, len(want))).eqNullSafe(F.array(*map(F.lit, want))) if want else have.isNotNull()
        else:
            found &= have.eqNullSafe(F.lit(want))
    return found
