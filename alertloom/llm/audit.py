"""How filters overlap: sorted lists of failing rows per part, merged by galloping, for every order of the filters."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.once import evaluated_once
from alertloom.llm.common import BLANKS, split_join, text_of
from alertloom.session import stored

#: Rows of a range of places: the most that a posting list of one range can hold.
RANGE_BITS = 16


def failures(docs: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``doc_id``, ``part``, ``sha`` (of the text) and a boolean for each condition over ``text`` and ``words``.

    ``words`` are the runs without ASCII white space, each text split once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = evaluated_once(rows, {"words": F.filter(F.split(F.translate("text", BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")})
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
                       *[F.coalesce(c, F.lit(False)).alias(name) for name, c in conditions.items()])


def text_conditions() -> dict[str, Column]:
    """When a text fails: A under 200 words, B under half of them distinct, C over 3 % upper case ASCII, D a mark of ``#$%&*|``."""
    text, words = F.col("text"), F.col("words")
    n = F.size(words).cast("long")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
            "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def later_copies(rows: DataFrame, name: str) -> DataFrame:
    """Add ``name``: whether another row has the same text (``sha``) and a smaller ``doc_id``; null ids come last."""
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sha", "_first")
    found = rows.withColumn("_again", F.xxhash64("sha")).join(first.withColumn("_again", F.xxhash64("sha")), ["sha", "_again"], "left")
    later = F.col("_first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_first")))
    return found.withColumn(name, later).drop("_first", "_again")


def found_in(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``ids`` in ``sorted_ids`` and whether they are there. Both ascend; the part of the longer list before the
    first and behind the last id is skipped, the rest is searched by bisection from each id to the next."""
    if not len(sorted_ids) or not len(ids):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    low = np.searchsorted(sorted_ids, ids[0])
    high = np.searchsorted(sorted_ids, ids[-1], "right")
    places = low + np.searchsorted(sorted_ids[low:high], ids)
    there = np.zeros(len(ids), bool)
    inside = places < len(sorted_ids)
    there[inside] = sorted_ids[places[inside]] == ids[inside]
    return places, there


def difference(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The ids that ``others`` lacks; the shorter list gallops through the longer."""
    if len(ids) <= len(others):
        return ids[~found_in(others, ids)[1]]
    places, there = found_in(ids, others)
    return np.delete(ids, places[there])


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both sorted lists as one; the shorter gallops through the longer."""
    if len(a) < len(b):
        a, b = b, a
    places, there = found_in(a, b)
    return np.insert(a, places[~there], b[~there])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many ids both lists have."""
    if len(a) < len(b):
        a, b = b, a
    return int(found_in(a, b)[1].sum())


def unions(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The union of every set of lists, by the set's bits: k-way merges, each built on the merge of one list less."""
    found = {0: np.zeros(0, np.int64)}
    for size in range(1, len(lists) + 1):
        for chosen in combinations(range(len(lists)), size):
            bits = sum(1 << k for k in chosen)
            found[bits] = union(found[bits ^ (1 << chosen[-1])], lists[chosen[-1]])
    return found


def step_counts(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """For each filter and each set of filters before it: filter, bits of the set, size of the set's union, and of what
    the filter takes after it the number of ids, of good and of toxic ones."""
    before, out = unions(lists), []
    for bits, gone in before.items():
        for k, ids in enumerate(lists):
            if not bits >> k & 1:
                taken = difference(ids, gone)
                out.append((k, bits, len(gone), len(taken), common(taken, good), common(taken, toxic)))
    return out


def _range_counts(names: list[str]):
    fields = ["filter", "before", "gone", "removed", "good", "toxic"]

    def counted(key, frame: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(frame["name"], frame["ids"], strict=True))
        empty = np.zeros(0, np.int64)
        rows = step_counts([np.asarray(held.get(n, empty), np.int64) for n in names], *(np.asarray(held.get(n, empty), np.int64) for n in ("good", "toxic")))
        return pd.DataFrame(rows, columns=fields).astype("int64").assign(part=key[0])[["part", *fields]]

    return counted


def posting_lists(rows: DataFrame, names: list[str], bits: int = RANGE_BITS) -> DataFrame:
    """``part``, ``range``, ``name``, ``ids``: the ascending places of the rows of a part that fail a filter, or are ``good`` or
    ``toxic``, cut into ranges of ``2 ** bits`` places. ``rows`` is a stored table; a row's place is its own."""
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    failing = F.array(*[F.when(F.col(n), F.lit(n)) for n in [*names, "good", "toxic"]])
    listed = placed.select("part", F.shiftright("place", bits).alias("range"), "place", F.explode(F.array_compact(failing)).alias("name"))
    return listed.groupBy("part", "range", "name").agg(F.sort_array(F.collect_list("place")).alias("ids"))


def interactions(rows: DataFrame, names: list[str], bits: int = RANGE_BITS) -> DataFrame:
    """What each filter does at each place of each order of all filters, for each part.

    ``rows``: a stored table with ``part``, a boolean for each of ``names``, ``good`` and ``toxic``. Posting lists of each range of
    places are merged by themselves; only sizes are added up over the ranges: for ``k`` filters ``k * 2 ** (k - 1)``
    rows a part and range. Returns ``part``, ``filter_order``, ``step`` (from 1), ``kept`` after the step, ``removed`` there,
    ``redundant`` (failing, removed earlier), ``unique_fails`` (failing this filter only), ``good_lost``,
    ``toxic_lost``, ``shapley`` (removed, summed over all orders). Parts without failing rows have zeros.
    """
    spark, k = rows.sparkSession, len(names)
    lists = stored(posting_lists(rows, names, bits))
    ranges = lists.groupBy("part", "range").applyInPandas(
        _range_counts(names), "part string, filter long, before long, gone long, removed long, good long, toxic long")
    sums = stored(ranges.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("gone", "removed", "good", "toxic")]))
    everyone = (1 << k) - 1
    alone = F.expr(f"before = {everyone}L - shiftleft(1L, cast(filter AS int))")
    weights = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") for s in range(k)]), F.bit_count("before") + 1)
    filters = sums.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weights).alias("shapley"))
    steps = []
    for order in permutations(range(k)):
        for step, at in enumerate(order):
            steps.append(("".join(names[x] for x in order), step + 1, at, sum(1 << x for x in order[:step])))
    # A fixed table: k * k! rows.
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter long, before long")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    grid = parts.crossJoin(F.broadcast(orders))
    found = grid.join(sums, ["part", "filter", "before"], "left").join(filters, ["part", "filter"], "left").na.fill(
        0, ["gone", "removed", "good", "toxic", "fails", "unique_fails", "shapley"])
    return found.select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """The interactions of five filters over ``docs``, a part for each ``lang``.

    Filters: those of ``text_conditions`` and E, the text of a row with a smaller ``doc_id`` anywhere in the table. Other columns
    than ``doc_id``, ``text``, ``lang`` are not read. Null text counts as empty, null ``lang`` as the part of the empty string;
    empty texts equal each other. Rows that repeat are counted each, and neither of two rows with one id and text is
    the later; null ids come after all others. A row is good or toxic if any row of ``labels`` (``doc_id``,
    ``quality``, ``toxic``) says 1 for its id; rows without an id or a label are neither. Without documents there are no parts.

    Texts are read once and don't leave their task; rows travel as an id, a part, 32 bytes and flags. A
    list holds at most ``2 ** bits`` places, so that neither a part nor a copy that fills the table meets in one task.
    """
    conditions = text_conditions()
    rows = later_copies(failures(docs, conditions), "E")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q"), F.col("toxic").alias("t")).groupBy("doc_id").agg(
        F.max(F.when(F.col("q") == 1, 1)).alias("_good"), F.max(F.when(F.col("t") == 1, 1)).alias("_toxic"))
    names = [*conditions, "E"]
    rows = split_join(rows.select("doc_id", "part", *names), said, ["doc_id"], "left")
    rows = stored(rows.select("part", *names, F.col("_good").isNotNull().alias("good"), F.col("_toxic").isNotNull().alias("toxic")))
    return interactions(rows, names, bits)
