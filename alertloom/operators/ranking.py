"""Model rankings out of judge results: positions, scores, wins, head-to-head.

``results``: incident_id, category, event_count, rankings (position -> model), scores (model ->
score). Everything works on the long forms below and on sums that Spark adds up before it
shuffles, so a few models over many results are no skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.alerts import CATEGORIES, COMPLEXITIES, complexity
from alertloom.functions.maps import last_entries
from alertloom.functions.once import evaluated_once
from alertloom.session import stored

COUNTED_POSITIONS = (1, 2, 3, 4)
# The places an absent model or an empty cell gets.
ABSENT_POSITION = 5
NO_POSITION = 999


def positions(results: DataFrame, *keep: str) -> DataFrame:
    """One row per ranked model."""
    return results.select(*keep, F.explode("rankings").alias("position", "model")) \
        .withColumn("position", F.col("position").cast("int"))


def scores(results: DataFrame, *keep: str) -> DataFrame:
    """One row per scored model."""
    return results.select(*keep, F.explode("scores").alias("model", "score"))


def long_results(results: DataFrame, *keep: str) -> DataFrame:
    """Positions and scores in one frame: (model, position or null, score or null). A model that
    is ranked but not scored, or the other way round, is kept."""
    ranked = F.transform(
        F.map_entries("rankings"),
        lambda e: F.struct(e["value"].alias("model"), e["key"].cast("int").alias("position"),
                           F.lit(None).cast("double").alias("score")),
    )
    scored = F.transform(
        F.map_entries("scores"),
        lambda e: F.struct(e["key"].alias("model"), F.lit(None).cast("int").alias("position"),
                           e["value"].cast("double").alias("score")),
    )
    none = F.array().cast("array<struct<model:string,position:int,score:double>>")
    both = F.concat(F.coalesce(ranked, none), F.coalesce(scored, none))
    return results.select(*keep, F.inline(both))


def model_stats(results: DataFrame) -> DataFrame:
    """Per model: how often at each place, wins, win rate over all results, mean place and score."""
    total = results.agg(F.count(F.lit(1))).scalar()
    counted = F.when(F.col("position").between(COUNTED_POSITIONS[0], COUNTED_POSITIONS[-1]),
                     F.col("position"))
    return (
        long_results(results).groupBy("model")
        .agg(
            *[F.count_if(F.col("position") == p).alias(f"position_{p}") for p in COUNTED_POSITIONS],
            F.coalesce(F.avg(counted), F.lit(0.0)).alias("avg_position"),
            F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        )
        .withColumn("wins", F.col("position_1"))
        .withColumn("win_rate", F.coalesce(F.try_divide(100.0 * F.col("wins"), total), F.lit(0.0)))
    )


def _by_kind(results: DataFrame, kind: Column, kinds: tuple[str, ...], name: str,
             models: list[str] | None) -> DataFrame:
    """Cells kind x model; a cell without positions is all zero even if it has scores."""
    cells = long_results(results.withColumn(name, kind), name) \
        .where(F.col(name).isin(*kinds)) \
        .groupBy(name, "model").agg(
            F.count("position").alias("count"),
            F.avg("position").alias("avg_position"),
            F.avg("score").alias("avg_score"),
            F.count_if(F.col("position") == 1).alias("wins"))
    spark = results.sparkSession
    names = spark.createDataFrame([(m,) for m in models], "model string") if models is not None \
        else long_results(results).select("model").distinct()
    grid = names.select("model", F.explode(F.array(*[F.lit(k) for k in kinds])).alias(name))
    known = F.col("count") > 0
    return grid.join(cells, [name, "model"], "left").select(
        name, "model", F.coalesce("count", F.lit(0)).alias("count"),
        *[F.when(known, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c)
          for c in ("avg_position", "avg_score")],
        F.coalesce("wins", F.lit(0)).alias("wins"),
    )


def model_by_category(results: DataFrame, models: list[str] | None = None) -> DataFrame:
    return _by_kind(results, F.col("category"), CATEGORIES, "category", models)


def model_by_complexity(results: DataFrame, models: list[str] | None = None) -> DataFrame:
    return _by_kind(results, complexity(F.col("event_count")), COMPLEXITIES, "complexity", models)


def _duels(results: DataFrame, absent_position: int) -> DataFrame:
    """For each two models that some result ranks together, and each model beside itself: in how many
    results ``model`` stands before ``rival``, before the absent place, and ``rival`` behind it.

    Of several places of a model the last counts. A result's entries are worked out once and give its few
    pairs in one pass over the table.
    """
    ranked = evaluated_once(results.select("rankings"), {"entries": F.map_entries("rankings")})
    ranked = evaluated_once(ranked.select("entries"), {"r": F.transform(last_entries(F.col("entries"), "value"), lambda e: F.struct(
        e["value"].alias("model"), e["key"].cast("int").alias("place")))})
    pairs = ranked.select("r", F.explode("r").alias("a")).select("a", F.explode("r").alias("b"))
    return pairs.groupBy(F.col("a.model").alias("model"), F.col("b.model").alias("rival")).agg(
        F.count_if(F.col("a.place") < F.col("b.place")).alias("first"),
        F.count_if(F.col("a.place") < absent_position).alias("before"),
        F.count_if(F.col("b.place") > absent_position).alias("after"))


def head_to_head(results: DataFrame, models: list[str] | None = None,
                 absent_position: int = ABSENT_POSITION) -> DataFrame:
    """Share of results in which ``model`` stands before ``rival``; a model not ranked stands last.

    Rows are made for the pairs that a result ranks, a few each, and added up per task. Pairs with a
    model that a result lacks follow from how often each stands before or after the absent place.
    Without ``models`` these are the scored ones.
    """
    # A row for each two models, read three times below.
    duels = stored(_duels(results, absent_position))
    single, both = duels.where("model = rival"), duels.where("model <> rival").toDF("model", "rival", "first", "both_before", "both_after")
    names = results.sparkSession.createDataFrame([(list(models),)], "names array<string>") if models is not None \
        else scores(results).agg(F.array_sort(F.collect_set("model")).alias("names"))
    grid = names.select("names", F.explode("names").alias("model")).select("model", F.explode("names").alias("rival")).where(
        "model <> rival")
    total = results.agg(F.count(F.lit(1))).scalar()
    none = F.lit(0)
    wins = (F.coalesce("first", none) + F.coalesce("before", none) - F.coalesce("both_before", none)
            + F.coalesce("rival_after", none) - F.coalesce("both_after", none))
    counted = (
        grid.join(both, ["model", "rival"], "left")
        .join(single.select("model", "before"), "model", "left")
        .join(single.select(F.col("model").alias("rival"), F.col("after").alias("rival_after")), "rival", "left")
        .select("model", "rival", wins.alias("wins"), total.alias("total"))
    )
    percent = F.coalesce(F.try_divide(100.0 * F.col("wins"), F.col("total")), F.lit(0.0))
    return counted.withColumn("win_percent", percent)


def model_rank(stats: DataFrame) -> DataFrame:
    """Models (a handful of rows) by mean place, equal ones by name."""
    order = Window.orderBy("avg_position", "model")
    return stats.withColumn("rank", F.row_number().over(order))


def filled_cell() -> Column:
    """Condition on cells: results were counted there. Report tables leave the others out."""
    return F.col("count") > 0


def best_model(stats: DataFrame, cells: DataFrame) -> DataFrame:
    """Best model overall and per category; a model without results there comes last."""
    overall = stats.agg(F.min_by("model", F.struct("avg_position", "model")).alias("model")).select(
        F.lit("overall").alias("scope"), "model")
    place = F.when(F.col("count") > 0, F.col("avg_position")).otherwise(F.lit(float(NO_POSITION)))
    per_category = cells.groupBy(F.col("category").alias("scope")).agg(
        F.min_by("model", F.struct(place, F.col("model"))).alias("model"))
    return overall.unionByName(per_category)


def judge_table(results: DataFrame, models: dict[str, str]) -> DataFrame:
    """One wide row per result: the four ranks, then score and place of each model. ``models``
    maps column prefix to model name; what a result lacks stays null."""
    def place(model: str) -> Column:
        return F.try_element_at(F.filter(F.map_entries("rankings"), lambda e: e["value"] == model), F.lit(-1))["key"]

    return results.select(
        "incident_id", "category", "event_count", "threat_level",
        *[F.try_element_at("rankings", F.lit(str(p))).alias(f"rank_{p}") for p in COUNTED_POSITIONS],
        *[F.try_element_at("scores", F.lit(m)).alias(f"{c}_score") for c, m in models.items()],
        *[place(m).cast("int").alias(f"{c}_position")
          for c, m in models.items()],
    )


def rankings_text(rankings: Column, letters: int = 4) -> Column:
    """``1:abcd → 2:efgh`` with model names cut short."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(rankings)),
                    lambda e: F.concat(e["key"], F.lit(":"), F.substring(e["value"], 1, letters))),
        " → ",
    )


def result_details(results: DataFrame, sample: DataFrame) -> DataFrame:
    """Results with the text of their incident and the winner; absent parts read ``N/A``."""
    winner = F.try_element_at("rankings", F.lit("1"))
    texts = [c for c in sample.columns if c != "incident_id"]
    return results.withColumns({
        "short_id": F.substring("incident_id", 1, 8),
        "winner": F.coalesce(winner, F.lit("N/A")),
        "winner_score": F.coalesce(F.try_element_at("scores", winner), F.lit(0.0)),
        "positions": rankings_text(F.col("rankings")),
    }).join(sample, "incident_id", "left").fillna("N/A", texts)


def chart_series(stats: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (chart, series, model, value) behind the win, place and category charts."""
    def unpivoted(df: DataFrame, chart: str, measures: list[str], prefix: Column) -> DataFrame:
        rows = F.array(*[
            F.struct(F.concat(prefix, F.lit(m)).alias("series"), F.col(m).cast("double").alias("value"))
            for m in measures
        ])
        return df.select(F.lit(chart).alias("chart"), "model", F.inline(rows)) \
            .select("chart", "series", "model", "value")

    category = F.concat(F.col("category"), F.lit("_"))
    parts = [
        unpivoted(stats, "wins", ["win_rate"], F.lit("")),
        unpivoted(stats, "places", [f"position_{p}" for p in COUNTED_POSITIONS], F.lit("")),
        unpivoted(cells, "category", ["count", "wins"], category),
    ]
    return reduce(DataFrame.unionByName, parts)
