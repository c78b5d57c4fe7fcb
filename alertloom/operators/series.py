"""Measured series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.times import elapsed_minutes


def elapsed(readings: DataFrame, series_col: str, ts_col: str) -> DataFrame:
    """Adds ``minutes`` since the first reading of the series."""
    starts = readings.groupBy(series_col).agg(F.min(ts_col).alias("_start"))
    return readings.join(starts, [series_col]).withColumn(
        "minutes", elapsed_minutes(F.col(ts_col), F.col("_start"))).drop("_start")
