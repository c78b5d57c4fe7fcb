"""Expressions over alert fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.functions.text import words

# Severity order, complexity limits on the number of events.
SEVERITY_RANKS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Info": 0, "Unknown": -1}
COMPLEXITY_LIMITS = (("simple", 500), ("medium", 2000))
LARGEST_COMPLEXITY = "complex"
COMPLEXITIES = ("simple", "medium", "complex")
CATEGORIES = ("Malware", "Normal")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(-1)
    for name, value in SEVERITY_RANKS.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def complexity(event_count: Column) -> Column:
    tier = F.lit(LARGEST_COMPLEXITY)
    for name, limit in reversed(COMPLEXITY_LIMITS):
        tier = F.when(event_count < limit, name).otherwise(tier)
    return F.when(event_count.isNotNull(), tier)


def addresses(endpoints: Column) -> Column:
    """IPs of a Source or Target list, order and repeats kept."""
    return F.coalesce(
        F.filter(F.transform(endpoints, lambda e: e["IP"]), lambda ip: ip.isNotNull()),
        F.array().cast("array<string>"),
    )


def ports(endpoints: Column) -> Column:
    lists = F.filter(F.transform(endpoints, lambda e: e["Port"]), lambda p: p.isNotNull())
    return F.coalesce(F.flatten(lists), F.array().cast("array<int>"))


def first_address(ips: Column) -> Column:
    return F.coalesce(F.try_element_at(ips, F.lit(1)), F.lit("Unknown"))


def _one_or_count(values: Column, noun: str) -> Column:
    only = F.try_element_at(values, F.lit(1)).cast("string")
    return F.when(F.size(values) == 1, only).otherwise(F.concat(F.size(values), F.lit(noun)))


def target_summary(ips: Column, ports_: Column, description: Column) -> Column:
    """What an event is aimed at; without target, the first word of its description."""
    address, port = _one_or_count(ips, " IPs"), _one_or_count(ports_, " ports")
    first_word = F.try_element_at(words(description), F.lit(1))
    return (
        F.when((F.size(ips) > 0) & (F.size(ports_) > 0), F.concat(address, F.lit(":"), port))
        .when(F.size(ips) > 0, address)
        .when(F.size(ports_) == 1, F.concat(F.lit("port "), port))
        .when(F.size(ports_) > 1, port)
        .otherwise(F.coalesce(first_word, F.lit("Unknown")))
    )


def note_map(note: Column, parsed: Column) -> Column:
    """The Note as a map, given what parsing it gave; text that is no JSON object is kept under
    ``raw``."""
    return (
        F.when(F.coalesce(note, F.lit("")) == "", F.create_map().cast("map<string,string>"))
        .when(parsed.isNull() | F.map_contains_key(parsed, ""), F.create_map(F.lit("raw"), note))
        .otherwise(parsed)
    )


def win_band(percent: Column) -> Column:
    return F.when(percent >= 60, "high").when(percent >= 40, "medium").otherwise("low")


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))


def megabytes(size: Column) -> Column:
    """Bytes in MB to one decimal, 0 if unknown."""
    return F.coalesce(F.round(size / F.lit(1024.0 * 1024.0), 1), F.lit(0.0))
