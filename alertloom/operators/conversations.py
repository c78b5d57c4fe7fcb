"""Chat datasets: statistics and transcripts.

Two shapes: ``conversation`` arrays of (role, content), one row per chat, and long turns (conv_id,
turn, role, text). Long turns are gathered per chat only as its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.skew import ordered_text


def conversation_stats(chats: DataFrame, col: str = "conversation") -> DataFrame:
    """Chats, turns, mean turns (empty chats count) and empty chats (one row)."""
    turns = F.coalesce(F.array_size(col), F.lit(0))
    return chats.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.coalesce(F.sum(turns), F.lit(0)).alias("total_turns"),
        F.coalesce(F.avg(turns), F.lit(0.0)).alias("avg_turns"),
        F.count_if(turns == 0).alias("empty_conversations"),
    )


def turn_stats(turns: DataFrame) -> DataFrame:
    """The same over long turns, where no chat is empty."""
    per_chat = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return per_chat.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_turns"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_turns"),
        F.lit(0).cast("bigint").alias("empty_conversations"),
    )


def _roles(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("role", F.lit("unknown")).alias("role")) \
        .agg(F.count(F.lit(1)).alias("turns"))


def role_distribution(chats: DataFrame, col: str = "conversation") -> DataFrame:
    return _roles(chats.select(F.inline(col)))


def turn_roles(turns: DataFrame) -> DataFrame:
    return _roles(turns.select("role"))


def first_chats(chats: DataFrame, n: int = 3, pos_col: str = "pos", col: str = "conversation") -> DataFrame:
    """Those of the first ``n`` chats that are not empty."""
    return chats.orderBy(pos_col).limit(n).where(F.array_size(col) > 0)


def turn_line(role: Column, content: Column) -> Column:
    speaker = F.when(role == "user", "User: ").otherwise("Assistant: ")
    return F.concat(speaker, F.coalesce(content, F.lit("")))


def transcripts(turns: DataFrame) -> DataFrame:
    """The prompt text of each chat, closed by the line that asks for the next reply."""
    lines = turns.select("conv_id", "turn", turn_line(F.col("role"), F.col("text")).alias("line"))
    return ordered_text(lines, ["conv_id"], ["turn"], "line").select(
        "conv_id", F.concat("text", F.lit("\nAssistant:")).alias("text"), (F.col("lines") + 1).alias("lines"))
