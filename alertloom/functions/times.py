"""Times as written: the wall clock of a string's own offset, never shifted to another zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date and time as group 1, then an offset that is left out.
_ISO = (
    r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?)?)"
    r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?$"
)


def wall_clock(text: Column) -> Column:
    """``timestamp_ntz`` of an ISO string, null if it is none."""
    plain = F.translate(F.regexp_extract(text, _ISO, 1), ",", ".")
    return plain.try_cast("timestamp_ntz")


def format_time(text: Column, short: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` or ``HH:mm``; empty stays empty, unreadable stays as it is."""
    text = F.coalesce(text, F.lit(""))
    clock = wall_clock(text).cast("string")
    shown = F.substring(clock, 12, 5) if short else F.substring(clock, 1, 19)
    return F.coalesce(shown, text)


def timeline(start: Column, end: Column) -> Column:
    begun, ended = format_time(start), format_time(end)
    return F.when(ended != "", F.concat(begun, F.lit(" to "), ended)).otherwise(begun)


def time_range(first: Column, last: Column) -> Column:
    """One time, or two joined by a dash; nothing known gives ``Unknown``."""
    return (
        F.when(first.isNull(), F.lit("Unknown"))
        .when(first == last, first)
        .otherwise(F.concat_ws("-", first, last))
    )


def elapsed_minutes(at: Column, start: Column) -> Column:
    """Minutes between two timestamps, with fractions."""
    return F.timestamp_diff("MICROSECOND", start, at) / F.lit(60_000_000.0)
