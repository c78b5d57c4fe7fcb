"""Columns that are worked out once per row, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row ``inline``.

    The optimizer copies a plain projected expression to every place that uses it, so parsing a
    line and reading ten of its fields could parse it ten times. It does not move expressions
    through a generator.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
