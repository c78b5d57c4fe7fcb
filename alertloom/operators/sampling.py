"""Samples that come out the same on every run: rows are ranked by a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.alerts import COMPLEXITIES, complexity

_PREFIX = 4  # hex digits of the hash: 65,536 slots


def hash_rank(identity: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), identity.cast("string")).cast("binary"))


def take_by_hash(df: DataFrame, id_col: str, n: int | None = None, fraction: float | None = None,
                 by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """The first ``n`` rows, or ``int(rows * fraction)`` rows, in hash order - of each group of
    ``by`` or of the whole table. ``id_col`` should be unique within a group.

    Neither the table nor a group is ever sorted in one task. One pass counts rows by slots of the
    hash, which tells in which slot the number is reached; a second passes on the rows up to that
    slot and ranks them within theirs. The slots of a group are as many rows as it has, 65,536 at most.
    """
    by = by or []
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    ranked = df.withColumn("_hash", hash_rank(F.col(id_col), seed))
    ranked = ranked.withColumn("_slot", F.conv(F.substring("_hash", 1, _PREFIX), 16, 10).cast("int"))
    counts = ranked.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*by)
    running = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_rows").over(whole)
    wanted = F.least(F.lit(n), total) if n is not None else F.floor(total * F.lit(float(fraction)))
    ends = (
        counts.withColumn("_upto", F.sum("_rows").over(running))
        .withColumn("_wanted", wanted)
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .where((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_upto")))
        .select(*by, F.struct(F.col("_slot").alias("slot"), (F.col("_wanted") - F.col("_before")).alias("need")).alias("_end"))
    )
    if by:
        placed = ranked.join(ends, by)
    else:  # one group, one end
        placed = ranked.withColumn("_end", ends.select("_end").scalar())
    place = Window.partitionBy(*by, "_slot").orderBy("_hash", id_col)
    return (
        placed.where(F.col("_slot") <= F.col("_end.slot"))
        .withColumn("_nth", F.row_number().over(place))
        .where((F.col("_slot") < F.col("_end.slot")) | (F.col("_nth") <= F.col("_end.need")))
        .select(df.columns)
    )


def sample_files(incidents: DataFrame, files: int, seed: int = 0) -> DataFrame:
    """Incidents of ``files`` files drawn from all files."""
    chosen = take_by_hash(incidents.select("source_file").distinct(), "source_file", n=files, seed=seed)
    return incidents.join(chosen, ["source_file"], "left_semi")


def sample_incidents(incidents: DataFrame, n: int | None = None, files: int | None = None,
                     per_file: int | None = None, category: str | None = None,
                     severity: str | None = None, seed: int = 0) -> DataFrame:
    """Draw files, filter, draw per file, then draw from the pool - in this order."""
    if n is None and per_file is None:
        raise ValueError("give n or per_file")
    if category is not None:
        incidents = incidents.where(F.lower("category") == category.lower())
    if files is not None:
        incidents = sample_files(incidents, files, seed)
    if severity is not None:
        incidents = incidents.where(F.lower(F.coalesce("severity", F.lit(""))) == severity.lower())
    if per_file is not None:
        incidents = take_by_hash(incidents, "incident_id", n=per_file, by=["source_file"], seed=seed)
    if n is not None:
        incidents = take_by_hash(incidents, "incident_id", n=n, seed=seed)
    return incidents


def sample_statistics(sample: DataFrame) -> DataFrame:
    """Rows (metric, key, value): totals, events per incident, counts by category, severity, dataset."""
    kinds = ["category", "severity", "dataset"]
    overall = sample.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.coalesce(F.sum("num_events"), F.lit(0)).alias("total_events"),
        F.min("num_events").alias("min_events"),
        F.max("num_events").alias("max_events"),
        F.avg("num_events").alias("avg_events"),
    )
    totals = overall.select([F.col(c).cast("double").alias(c) for c in overall.columns]) \
        .select(F.lit("").alias("key"), "*").unpivot(["key"], overall.columns, "metric", "value")
    kind = F.lit("")
    for k in kinds:
        kind = F.when(F.grouping(k) == 0, f"by_{k}").otherwise(kind)
    counts = (
        sample.withColumn("severity", F.coalesce("severity", F.lit("Unknown")))
        .groupingSets([[k] for k in kinds], *kinds)
        .agg(kind.alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
    )
    return totals.unionByName(counts.select("metric", F.coalesce(*kinds).alias("key"), "value"))


def evaluation_statistics(sample: DataFrame) -> DataFrame:
    """Rows (category, incidents, share, range and mean of events and threat level); category
    null is the whole sample."""
    total = sample.agg(F.count(F.lit(1))).scalar()
    measures = [
        f(c).alias(f"{label}_{c}")
        for c in ("event_count", "threat_level")
        for label, f in (("min", F.min), ("max", F.max), ("avg", F.avg))
    ]
    return sample.groupingSets([[], ["category"]], "category").agg(
        F.count(F.lit(1)).alias("incidents"),
        (100.0 * F.try_divide(F.count(F.lit(1)), total)).alias("share"),
        *measures,
    )


def stratified_sample(df: DataFrame, target: int = 50, seed: int = 42, keep_all: str = "Normal",
                      strata_of: str = "Malware", id_col: str = "incident_id",
                      pos_col: str = "pos") -> DataFrame:
    """All rows of one category, filled up to ``target`` from the other in equal shares per
    complexity tier. The first tiers get the remainder, a short tier is taken whole and what it
    lacks is drawn from the rest. If the kept category alone reaches the target, its first rows
    in input order are the sample. ``sample_order`` is the shuffled order.

    Only ``target`` rows of each stratum can matter, so strata are cut to that many first.
    """
    kept = df.where(F.col("category") == keep_all).orderBy(pos_col).limit(target)
    strata = df.where(F.col("category") == strata_of) \
        .withColumn("_tier", complexity(F.col("event_count")))
    pool = take_by_hash(strata, id_col, n=target, by=["_tier"], seed=seed)
    rows = kept.withColumn("_tier", F.lit("kept")).unionByName(pool) \
        .withColumn("_hash", hash_rank(F.col(id_col), seed))

    def tier_size(tier: str) -> Column:
        return F.count_if(F.col("_tier") == tier).over(Window.partitionBy())

    need = F.greatest(F.lit(target) - tier_size("kept"), F.lit(0))
    share, rest = F.floor(need / 3), need % 3
    quota = F.lit(None).cast("bigint")
    taken = F.lit(0)
    for i, tier in enumerate(COMPLEXITIES):
        own = share + F.when(rest > i, 1).otherwise(0)
        quota = F.when(F.col("_tier") == tier, own).otherwise(quota)
        taken = taken + F.least(own, tier_size(tier))
    nth = F.row_number().over(Window.partitionBy("_tier").orderBy("_hash", id_col))
    rows = rows.withColumn("_missing", need - taken).withColumn(
        "_picked", (F.col("_tier") == "kept") | (nth <= quota)
    )
    spare = F.row_number().over(Window.partitionBy("_picked").orderBy("_hash", id_col))
    rows = rows.withColumn("_spare", spare).where(
        F.col("_picked") | (F.col("_spare") <= F.col("_missing"))
    )
    order = F.row_number().over(Window.orderBy("_hash", id_col))
    return rows.withColumn("sample_order", order).select(*df.columns, "sample_order")


def mix(frames: list[DataFrame], ratios: list[float], id_col: str, seed: int = 42) -> DataFrame:
    """From each frame ``int(its rows * its ratio)`` rows, put together."""
    if len(frames) != len(ratios):
        raise ValueError("one ratio per frame")
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("ratios must add up to 1")
    mixed = None
    for frame, ratio in zip(frames, ratios):
        part = take_by_hash(frame, id_col, fraction=ratio, seed=seed)
        mixed = part if mixed is None else mixed.unionByName(part)
    return mixed


def label_shuffle(df: DataFrame, models: list[str], labels: list[str], id_col: str = "incident_id",
                  seed: int = 0) -> DataFrame:
    """Hide which model wrote what: per row a map from label to model in shuffled order."""
    key = F.col(id_col).cast("string")
    ranked = F.array(*[
        F.struct(hash_rank(F.concat_ws("|", key, F.lit(m)), seed).alias("h"), F.lit(m).alias("m"))
        for m in models
    ])
    shuffled = F.transform(F.array_sort(ranked), lambda r: r["m"])
    return df.withColumn(
        "randomization", F.map_from_arrays(F.array(*[F.lit(v) for v in labels[: len(models)]]), shuffled)
    )


def prompt_grid(df: DataFrame, dimensions: dict[str, list[str]], id_col: str, seed: int = 0) -> DataFrame:
    """One independent choice per dimension for every row, drawn by hash."""
    def choice(name: str, values: list[str]) -> Column:
        draw = hash_rank(F.concat_ws("|", F.lit(name), F.col(id_col).cast("string")), seed)
        index = F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint") % len(values)
        return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))

    return df.withColumns({name: choice(name, values) for name, values in dimensions.items()})


def accept_first(attempts: DataFrame, count: int, attempt_col: str = "attempt",
                 valid_col: str = "valid", per_wanted: int = 3) -> DataFrame:
    """The first ``count`` valid rows among the attempts 1 to ``per_wanted * count``, with the
    number still lacking."""
    tried = attempts.where(F.col(attempt_col) <= per_wanted * count)
    valid = tried.where(valid_col)
    found = F.least(F.lit(count), valid.agg(F.count(F.lit(1))).scalar())
    return valid.orderBy(attempt_col).limit(count).withColumn("shortfall", F.lit(count) - found)
