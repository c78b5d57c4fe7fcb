"""Pass rates of prompt-test suites and their relation to serving speed.

``runs``: eval_id, provider, passed, failed. ``meta``: eval_id, suite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.session import stored


# From how many tokens per second a model counts as fast, and how many of the
# suites, in name order, the mean takes in when asked to leave the last one out.
FAST = 8.0


def with_description(runs: DataFrame, meta: DataFrame) -> DataFrame:
    """Runs with the suite of their evaluation. They are added up per provider and evaluation
    first, so an evaluation run very often is joined as a few rows."""
    added = runs.groupBy("provider", "eval_id").agg(
        F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))
    return added.join(meta, ["eval_id"], "left")


def pass_rate(runs: DataFrame, leave_out: list[str] | None = None) -> DataFrame:
    """Percent of passed tests per provider and suite, two decimals."""
    if leave_out:
        runs = runs.where(~F.col("provider").isin(*leave_out))
    totals = runs.groupBy("provider", "suite").agg(
        F.sum("passed").alias("total_pass"), F.sum("failed").alias("total_fail"))
    share = F.try_divide(100.0 * F.col("total_pass"), F.col("total_pass") + F.col("total_fail"))
    return totals.withColumn("pass_rate", F.round(share, 2))


def pass_matrix(rates: DataFrame, suites: list[str]) -> DataFrame:
    """Providers by suites. The suites are named, so no job is needed to find them."""
    return rates.groupBy("provider").pivot("suite", suites).agg(F.first("pass_rate"))


def long_matrix(matrix: DataFrame, key: str = "provider", name: str = "suite",
                value: str = "score") -> DataFrame:
    """The matrix as rows, without the empty cells."""
    return matrix.unpivot([key], [c for c in matrix.columns if c != key], name, value).na.drop()


def best_per_suite(long: DataFrame) -> DataFrame:
    """The best provider of each suite, exactly one; equal scores go by name."""
    order = Window.partitionBy("suite").orderBy(F.desc("score"), "provider")
    return long.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1).select(
        "suite", F.col("provider").alias("best_model"), F.col("score").alias("best_score"))


def speed_of_best(best: DataFrame, bench: DataFrame) -> DataFrame:
    return bench.join(best, bench["model"] == best["best_model"])


def best_fast_per_suite(long: DataFrame, bench: DataFrame, threshold: float = FAST) -> DataFrame:
    """Best provider of each suite beside the best among those that are fast and best somewhere. The
    scores, a row for each provider and suite, are read three times and so written once."""
    long = stored(long)
    best = best_per_suite(long)
    fast = speed_of_best(best, bench).where(F.col("tokens_per_second") > threshold)
    quick = best_per_suite(
        long.join(fast.select(F.col("model").alias("provider")), "provider", "left_semi")
    ).select("suite", F.col("best_model").alias("fast_model"), F.col("best_score").alias("fast_score"))
    return best.join(quick, "suite", "left").withColumn(
        "score_gap", F.abs(F.col("best_score") - F.col("fast_score")))


def gap_rows(pairs: DataFrame) -> DataFrame:
    """Two rows per suite: the best score overall and the best fast one, each with its model."""
    def row(kind: str, score: str, model: str):
        return F.struct(F.lit(kind).alias("type"), F.col(score).alias("score"), F.col(model).alias("model"))

    return pairs.select("suite", "score_gap", F.inline(F.array(
        row("Best Overall", "best_score", "best_model"), row("Best >8 TPS", "fast_score", "fast_model"))))


def mean_rank(matrix: DataFrame, suites: list[str] | None = None, drop_last: bool = False) -> DataFrame:
    """Mean over the suites per provider, best first. ``drop_last`` leaves the last suite in
    column order out, which published tables did by mistake. A missing cell makes the mean null."""
    suites = suites or [c for c in matrix.columns if c != "provider"]
    if drop_last:
        suites = suites[:-1]
    total = sum((F.col(f"`{s}`") for s in suites[1:]), F.col(f"`{suites[0]}`"))
    return matrix.select("provider", (total / len(suites)).alias("score")) \
        .orderBy(F.desc("score"), "provider")


def rank_with_speed(ranks: DataFrame, bench: DataFrame) -> DataFrame:
    return ranks.join(bench.withColumnRenamed("model", "provider"), "provider", "left")


def append_rows(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Add hand-written rows; fields they lack are null."""
    made = df.sparkSession.createDataFrame(
        [tuple(r.get(c) for c in df.columns) for r in rows], df.schema)
    return df.unionByName(made)
