"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import split_join, text_of
from alertloom.session import stored

OTHER = "(other)"
#: Cells raked on the driver and sent to the tasks, at most.
ON_DRIVER = 1 << 17
#: Copies of one document, at most; targets that need more are met as far as that goes.
MOST_COPIES = 16


def n_tokens(text: Column) -> Column:
    """Words of a text, split at ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def layout_topic(text: Column) -> Column:
    """A topic by layout: rows of a table, shouting, marked words or prose."""
    size = F.greatest(F.char_length(text), F.lit(1))
    bars, marks, capitals = (F.regexp_count(text, F.lit(p)) for p in (r"[|]", r"[*&%$#]", r"[A-Z]"))
    return (F.when(bars * 50 > size, "table").when(capitals * 3 > size, "shouting").when(marks * 10 > size, "marked").otherwise("prose"))


def listed(value: Column, names: list[str]) -> Column:
    """The value if the targets name it, else the common rest; null is in the rest."""
    known = [n for n in names if n != OTHER]
    return F.when(value.isin(*known), value).otherwise(F.lit(OTHER)) if known else F.lit(OTHER)


def rake(mass: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Scale a table of masses until its share along each axis is the target's.

    Iterative proportional fitting: one axis at a time, again and again. Targets of slices
    without mass are spread over the rest, since nothing can be scaled to them.
    """
    return rake_cells(mass.ravel(), list(np.indices(mass.shape).reshape(mass.ndim, -1)), targets, rounds, tolerance).reshape(mass.shape)


def rake_cells(mass: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500,
               tolerance: float = 1e-9) -> np.ndarray:
    """``rake`` of listed cells: ``places`` has the number of each cell's slice along each axis."""
    table = mass / max(mass.sum(), 1e-300)
    axes = range(len(targets))

    def margin(k: int) -> np.ndarray:
        return np.bincount(places[k], table, len(targets[k])).astype(np.float64)

    wanted = []
    for k in axes:
        want = np.where(margin(k) > 0, targets[k], 0.0)
        wanted.append(want / want.sum() if want.sum() > 0 else margin(k))
    for _ in range(rounds if len(table) else 0):
        for k in axes:
            now = margin(k)
            table = table * np.divide(wanted[k], now, out=np.zeros_like(now), where=now > 0)[places[k]]
        if max(np.abs(margin(k) - wanted[k]).max() for k in axes) < tolerance:
            break
    return table


def rake_table(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """``rake`` of a table of any number of cells: a column for each dimension and ``tokens``.

    Adds ``own`` and ``raked``, shares of the whole. ``targets`` has ``value`` and ``target`` for each
    dimension. Each step is a grouped sum by one dimension and a join with it; a round of all dimensions is written to the
    checkpoint folder. It ends where no share is off by more than ``tolerance``, far below what a draw can show. A null
    value of a dimension counts as ``(other)``.
    """
    dimensions = list(targets)
    cells = cells.withColumns({d: F.coalesce(F.col(d), F.lit(OTHER)) for d in dimensions})
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumns({"own": F.lit(0.0), "raked": F.lit(0.0)})
    table = stored(cells.withColumn("own", F.col("tokens") / F.lit(float(total))).withColumn("raked", F.col("own")))
    wanted = {}
    for d in dimensions:
        there = table.groupBy(d).agg(F.sum("raked").alias("m")).join(targets[d].withColumnRenamed("value", d), d, "left").select(
            d, "m", F.when(F.col("m") > 0, F.coalesce("target", F.lit(0.0))).otherwise(0.0).alias("want"))
        there = stored(there)
        whole = there.agg(F.sum("want")).first()[0] or 0.0
        wanted[d] = stored(there.select(d, (F.col("want") / F.lit(whole) if whole > 0 else F.col("m")).alias("want")))
    for _ in range(rounds):
        for d in dimensions:
            now = table.groupBy(d).agg(F.sum("raked").alias("m"))
            factor = now.join(wanted[d], d).select(d, F.when(F.col("m") > 0, F.col("want") / F.col("m")).otherwise(0.0).alias("f"))
            table = split_join(table, factor, [d]).withColumn("raked", F.col("raked") * F.col("f")).drop("f")
        table = stored(table)
        gaps = [table.groupBy(d).agg(F.sum("raked").alias("m")).join(wanted[d], d).agg(F.max(F.abs(F.col("m") - F.col("want")))).first()[0]
                for d in dimensions]
        if max(gaps) < tolerance:
            break
    return table


def token_counts(docs: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Tokens by combination of values: a column for each dimension and ``tokens``. Written to the
    checkpoint folder, so that texts are read once for targets and cells."""
    return stored(docs.select(*[c.cast("string").alias(d) for d, c in dimensions.items()], n_tokens(text_of()).alias("tokens")).groupBy(
        *dimensions).agg(F.sum("tokens").alias("tokens")))


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | DataFrame], dimensions: dict[str, Column], *,
        counts: DataFrame | None = None, share: float | None = None, seed: str = "mix", on_driver: int = ON_DRIVER,
        most_copies: int = MOST_COPIES, draw: Column | None = None) -> DataFrame:
    """Adds ``mix_weight``, ``mix_probability``, ``mix_copies`` and ``sampled`` to the documents.

    ``targets`` gives for each dimension the wanted share of tokens by value: a dictionary, whose
    unnamed values share the weight under ``(other)``, or a table ``value``, ``target`` of all values.
    The tokens by cell (a combination of values that occurs) are summed by Spark and raked to all
    marginals: on the driver up to ``on_driver`` cells, else as a Spark table; the results are the same.
    A cell's weight is its raked share by its own share. Each document has an expected number of
    copies in proportion to the weight: scaled so that the heaviest cell is taken once, or, with
    ``share``, so that this share of all tokens is drawn, repeats counted. ``mix_copies`` is that number rounded up
    or down at random, ``sampled`` whether it is above 0, ``mix_probability`` the chance of that. So a
    cell that needs more than it has is repeated, and the copies have the target weights; no document has more than
    ``most_copies``. A cell that would need more gives what it has so often, and the others make up for it, in proportion
    to their weights (``reached_shares`` says what comes of the targets).

    The draw compares a hash of ``seed``, id and text with the fraction: a rerun draws the same rows, and
    rows that repeat id and text go together; ``draw`` can give that fraction as a column. No row is shuffled up to ``on_driver`` cells; more cells are joined.
    Null values, and values that a dictionary does not name, go to ``(other)``; null text has no tokens, and a cell
    without tokens has weight 1. An empty table gives no rows. Columns of ``docs`` with the names of the four are replaced.
    """
    spark = docs.sparkSession

    def value(d: str, column: Column) -> Column:
        return listed(column, list(targets[d])) if isinstance(targets[d], dict) else F.coalesce(column, F.lit(OTHER))

    wanted = {d: spark.createDataFrame([(v, float(t)) for v, t in ({OTHER: 0.0} | targets[d]).items()], "value string, target double")
              if isinstance(targets[d], dict) else targets[d] for d in dimensions}
    counts = token_counts(docs, dimensions) if counts is None else counts
    cells = stored(counts.groupBy(*[value(d, F.col(d)).alias(d) for d in dimensions]).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")))
    few = cells.count() <= on_driver
    raked = stored(rake_here(cells, wanted) if few else rake_table(cells, wanted))
    weight = F.when(F.col("own") > 0, F.col("raked") / F.col("own")).otherwise(1.0)
    if share is None:
        scale = 1.0 / (raked.where("own > 0").agg(F.max(weight)).first()[0] or 1.0)
    else:
        scale = scale_for(raked, share, most_copies)
    names = [f"_cell_{k}" for k in range(len(dimensions))]
    weights = raked.select(*[F.col(d).alias(n) for d, n in zip(dimensions, names)], weight.alias("_weight"))
    draw = fraction(seed) if draw is None else draw
    placed = docs.select(F.struct("*").alias("row"), draw.alias("draw"), *[value(d, c.cast("string")).alias(n) for (d, c), n in zip(dimensions.items(), names)])
    placed = placed.join(F.broadcast(weights) if few else weights, names, "left").withColumn("_weight", F.coalesce("_weight", F.lit(1.0)))
    # A product of inverses can end a rounding error above the whole number.
    expected = F.least(F.round(F.col("_weight") * F.lit(scale), 12), F.lit(float(most_copies)))
    copies = (F.floor(expected) + (F.col("draw") < expected - F.floor(expected)).cast("long")).cast("long")
    added = {"mix_weight": F.col("_weight"), "mix_probability": F.least(expected, F.lit(1.0)), "mix_copies": copies, "sampled": copies > 0}
    kept = [F.col("row").getField(name).alias(name) for name in docs.columns if name.lower() not in added]
    return placed.select(*kept, *[c.alias(name) for name, c in added.items()])


def fraction(seed: str = "mix") -> Column:
    """A number from 0 to 1 by a hash of ``seed``, id and text."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text_of()), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _copies(scale: Column | float, most: int) -> Column:
    """Expected copies of the documents of a raked cell."""
    return F.least(F.when(F.col("own") > 0, F.col("raked") / F.col("own")).otherwise(0.0) * scale, F.lit(float(most)))


def scale_for(raked: DataFrame, share: float, most: int) -> float:
    """The number by which weights become copies so that ``share`` of all tokens is drawn though no document has more than ``most``.

    The drawn share grows with the scale; each pass over the cells tries 32 scales between two bounds.
    """
    low, high = share, share
    if raked.agg(F.sum(F.col("own") * _copies(low, most))).first()[0] in (None, 0):
        return share
    reachable = raked.agg(F.sum(F.when(F.col("raked") > 0, F.col("own") * most))).first()[0] or 0.0
    share = min(share, reachable * (1 - 1e-9))
    for _ in range(60):
        if (raked.agg(F.sum(F.col("own") * _copies(high, most))).first()[0] or 0.0) >= share - 1e-12:
            break
        high *= 4
    for _ in range(8):
        if high - low <= 1e-9 * high:
            break
        tries = [low + (high - low) * k / 31 for k in range(32)]
        drawn = raked.agg(*[F.sum(F.col("own") * _copies(t, most)) for t in tries]).first()
        k = next((k for k in range(32) if (drawn[k] or 0.0) >= share - 1e-12), 31)
        low, high = tries[max(k - 1, 0)], tries[k]
    return high


def reached_shares(docs: DataFrame, targets: dict[str, DataFrame], dimensions: dict[str, Column], *, counts: DataFrame | None = None,
                   share: float = 0.8, most_copies: int = MOST_COPIES) -> DataFrame:
    """What comes of the targets: ``dimension``, ``value``, ``own`` (share of the tokens there are), ``target``, ``drawn`` (expected share
    of the tokens drawn). They differ where a value's documents would have to be repeated more than ``most_copies`` times."""
    counts = token_counts(docs, dimensions) if counts is None else counts
    cells = stored(counts.groupBy(*[F.coalesce(F.col(d), F.lit(OTHER)).alias(d) for d in dimensions]).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")))
    raked = stored(rake_here(cells, targets) if cells.count() <= ON_DRIVER else rake_table(cells, targets))
    drawn = raked.withColumn("_drawn", F.col("own") * _copies(scale_for(raked, share, most_copies), most_copies))
    whole = drawn.agg(F.sum("_drawn")).first()[0] or 1.0
    parts = [drawn.groupBy(F.col(d).alias("value")).agg(F.sum("own").alias("own"), (F.sum("_drawn") / F.lit(whole)).alias("drawn")).join(
        target, "value", "left").select(F.lit(d).alias("dimension"), "value", "own", F.coalesce("target", F.lit(0.0)).alias("target"), "drawn")
        for d, target in targets.items()]
    return reduce(DataFrame.union, parts)


def rake_here(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``rake_table`` on the driver."""
    spark, found = cells.sparkSession, cells.toPandas()
    mass = found["tokens"].to_numpy(np.float64)
    places, wanted = [], []
    for d, target in targets.items():
        place, values = pd.factorize(found[d], sort=True)
        aims = target.join(F.broadcast(cells.select(F.col(d).alias("value")).distinct()), "value", "left_semi").toPandas().set_index("value")["target"]
        places.append(place)
        wanted.append(aims.reindex(values).fillna(0.0).to_numpy(np.float64))
    rows = [(*names, float(own), float(raked)) for *names, own, raked in zip(
        *[found[d] for d in targets], mass / max(mass.sum(), 1), rake_cells(mass, places, wanted))]
    return spark.createDataFrame(rows, ", ".join([*[f"`{d}` string" for d in targets], "own double", "raked double"]))


def tempered(counts: DataFrame, dimension: str, power: float) -> DataFrame:
    """Targets in proportion to a power of the token counts, for every value: ``value``, ``target``.

    Null is a value of its own, ``(other)``.
    """
    by_value = stored(counts.groupBy(F.coalesce(F.col(dimension), F.lit(OTHER)).alias("value")).agg(F.sum("tokens").alias("t")).where(
        "t > 0").select("value", F.pow("t", F.lit(power)).alias("p")))
    whole = by_value.agg(F.sum("p")).first()[0] or 1.0
    return by_value.select("value", (F.col("p") / F.lit(whole)).alias("target"))


TOPIC_TARGETS = {"prose": 0.85, "table": 0.05, "marked": 0.05, "shouting": 0.05, OTHER: 0.0}


def document_targets(counts: DataFrame, power: float) -> dict[str, DataFrame | dict[str, float]]:
    """Tempered targets for source and language (large ones less than their size, small ones more), ``TOPIC_TARGETS`` for topics."""
    return {"source": tempered(counts, "source", power), "lang": tempered(counts, "lang", power), "topic": TOPIC_TARGETS}


def mixed_documents(docs: DataFrame, power: float = 0.7, share: float = 0.8) -> DataFrame:
    """``mix`` over the documents' source, language and layout topic, to ``document_targets``.

    About ``share`` of all tokens is drawn, repeats counted.
    """
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": layout_topic(text_of())}
    counts = token_counts(docs, dimensions)
    return mix(docs, document_targets(counts, power), dimensions, counts=counts, share=share)


def mixing_table(docs: DataFrame, power: float = 0.7, share: float = 0.8) -> DataFrame:
    """``mixed_documents`` without the texts: ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens`` and the four columns of ``mix``.

    Texts are read once; what is needed of them is written to the checkpoint folder, narrow.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       layout_topic(text_of()).alias("topic"), n_tokens(text_of()).alias("n_tokens"), fraction().alias("_draw"))
    rows = stored(rows)
    dimensions = {d: F.col(d) for d in ("source", "lang", "topic")}
    counts = stored(rows.groupBy(*dimensions).agg(F.sum("n_tokens").alias("tokens")))
    return mix(rows, document_targets(counts, power), dimensions, counts=counts, share=share, draw=F.col("_draw")).drop("_draw")
