"""Chat records as ``array<struct<role, content>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two system lines of the built records.
ASSISTANT_LINE = "You are a helpful assistant."
REASONING_LINE = "You are a helpful assistant that provides step-by-step reasoning."


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def alpaca_chat(instruction: Column, extra: Column, output: Column) -> Column:
    asked = F.when(F.coalesce(extra, F.lit("")) != "", F.concat(instruction, F.lit("\n\n"), extra)) \
        .otherwise(instruction)
    return F.array(turn("system", F.lit(ASSISTANT_LINE)), turn("user", asked), turn("assistant", output))


def reasoning_chat(problem: Column, solution: Column) -> Column:
    return F.array(turn("system", F.lit(REASONING_LINE)), turn("user", problem),
                   turn("assistant", solution))


def sharegpt_chat(turns: Column) -> Column:
    """Turns of ``from``/``value``; those lacking either are skipped."""
    whole = F.filter(turns, lambda t: t["from"].isNotNull() & t["value"].isNotNull())
    return F.transform(
        whole,
        lambda t: F.struct(
            F.when(t["from"] == "human", "user").otherwise("assistant").alias("role"),
            t["value"].alias("content"),
        ),
    )


def transcript(turns: Column, prefixes: dict[str, str] | None = None, suffix: str = "",
               prompt: str = "\nAssistant:") -> Column:
    """Turns as lines with a prefix per role, closed by the line that asks for the next reply."""
    prefixes = prefixes or {"user": "User: ", "assistant": "Assistant: "}

    def line(t: Column) -> Column:
        prefix = F.lit(prefixes.get("assistant", ""))
        for role, text in prefixes.items():
            prefix = F.when(t["role"] == role, text).otherwise(prefix)
        return F.concat(prefix, F.coalesce(t["content"], F.lit("")), F.lit(suffix))

    return F.concat(F.array_join(F.transform(turns, line), "\n"), F.lit(prompt))
