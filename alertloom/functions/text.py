"""String expressions over descriptions, replies and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide which descriptions count as the same. The engine's regex
# flag (?U) gives \d, \s and \b their Unicode meaning.
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
PORT_AND_PROTOCOL = r"\b\d+/(?:TCP|UDP)\b"
NORMALISING = (
    (rf"(?U){IPV4}", "<IP>"),
    (r"(?iU)\b\d+/TCP\b", "<PORT>/TCP"),
    (r"(?iU)\b\d+/UDP\b", "<PORT>/UDP"),
    (r"(?iU)port[s]?:?\s*\d+(-\d+)?", "port <PORT>"),
    (r"(?U)\b\d+\b", "<NUM>"),
)

# What chat tools wrap around a reply.
REPLY_PREFIX = "AI: "
REPLY_STATISTICS = "🧠 Stats:"

_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def words(text: Column) -> Column:
    """Split at runs of white space; blank text has no words."""
    return F.filter(F.split(text, rf"(?U){_BLANK}+"), lambda w: w != "")


def normalise_pattern(description: Column) -> Column:
    """Replace addresses, ports and numbers by placeholders, in that order. Every pattern needs a
    digit, so text without one is passed through."""
    replaced = reduce(
        lambda text, step: F.regexp_replace(text, step[0], step[1]), NORMALISING, description
    )
    return F.when(description.rlike(r"(?U)\d"), replaced).otherwise(description)


def sample_values(description: Column, per_kind: int = 2) -> Column:
    """The first addresses, then the first ``port/protocol`` mentions, as written."""
    addresses = F.regexp_extract_all(description, F.lit(rf"(?U){IPV4}"), F.lit(0))
    ports = F.regexp_extract_all(description, F.lit(rf"(?iU){PORT_AND_PROTOCOL}"), F.lit(0))
    return F.concat(F.slice(addresses, 1, per_kind), F.slice(ports, 1, per_kind))


def clean_reply(reply: Column, cut_statistics: bool = True) -> Column:
    """Drop the speaker prefix everywhere and, unless told not to, the trailing statistics."""
    text = F.replace(reply, F.lit(REPLY_PREFIX), F.lit(""))
    if cut_statistics:
        text = F.substring_index(text, REPLY_STATISTICS, 1)
    return strip(text)


def truncated(text: Column, length: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(suffix))) \
        .otherwise(text)


def model_file_name(tag: Column, drop_size: bool = False) -> Column:
    """A model tag as a file name. ``drop_size`` also cuts ``:size``, so two sizes share a name."""
    name = F.replace(tag, F.lit("/"), F.lit("_"))
    return F.regexp_replace(name, r":.*$", "") if drop_size else name


def without_provider_prefix(provider: Column) -> Column:
    return F.regexp_replace(provider, r"^openai:chat:", "")


def filled(template: str, values: dict[str, Column]) -> Column:
    """Put columns into ``{{name}}`` places of a template; a null value leaves an empty place."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return text
