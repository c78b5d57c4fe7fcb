"""Texts and numbers of lines for keys that may have very many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_text(lines: DataFrame, keys: list[str], order: list[str], line: str,
                 separator: str = "\n") -> DataFrame:
    """One text for each key: its lines in order, with their number."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line)))
    text = F.array_join(F.transform(rows, lambda r: r[line]), separator)
    return lines.groupBy(*keys).agg(text.alias("text"), F.count(F.lit(1)).alias("lines"))


def numbered_lines(lines: DataFrame, keys: list[str], pos: str, width: int = 10_000) -> DataFrame:
    """Adds ``number``, the rank of each line in its key by ``pos``, an integer: for texts too long for one value.

    Lines are ranked within ranges of ``width`` places, and the lines of earlier ranges are added
    up from their counts, so a key of any length is spread over its ranges. Equal places are
    numbered in any order.
    """
    ranged = lines.withColumn("_range", F.floor(F.col(pos) / width))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_range", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(pos)
    return ranged.withColumn("_nth", F.row_number().over(inside)).join(before, [*keys, "_range"]).withColumn(
        "number", F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")
