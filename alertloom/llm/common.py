"""Helpers shared by the corpus operators: row keys, words and hashes in numpy, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import stored

#: The ASCII white space of all word and text rules here: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_GOLDEN, _MIX1, _MIX2 = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: An odd base has an inverse modulo 2**64, so that hashes of spans come from prefix sums.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)


def with_package(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers look for this package where the driver has it too, also
    when the driver was started in another folder. On a cluster that ships it, nothing changes."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64-bit key of a row by its id and text. Rows that repeat both share it."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text_of(text))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, kept as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` for each pair; equal content gives equal hashes."""
    up, down = _POWERS.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + lengths * _GOLDEN)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of the bytes of a text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BLANK[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


#: What a worker process keeps from one task to the next, by the operator that it is for.
KEPT: dict[str, Any] = {}


def only_kept(name: str | None) -> None:
    """Drop what this worker keeps for other operators than ``name``."""
    for other in [k for k in KEPT if k != name]:
        del KEPT[other]


def frugal(task: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """``task`` over batches in a worker that takes no more memory than it needs before and after it.

    Spark uses workers again for all that runs later. So what earlier tasks kept for other operators than
    ``keeps`` is dropped first, and what Arrow's memory pool holds unused goes back in the end.
    """
    def run(batches: Iterator) -> Iterator:
        only_kept(keeps)
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with an aggregate by the same keys, whose hot keys Spark can split.

    By itself Spark leaves both sides where the aggregation put them, and then all rows of a key
    meet in one task. A second key, made from the others, has it exchange both sides for the
    join alone.
    """
    again = F.xxhash64(*on)
    return left.withColumn("_again", again).join(right.withColumn("_again", again), [*on, "_again"], how).drop("_again")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a graph given by its edges of long node numbers.

    Returns ``node`` and ``root`` (the smallest node of its component), one row for each node that
    has an edge. Every round links each node to the smallest of its neighbours and itself, first
    seen from its larger neighbours, then from its smaller ones, until nothing changes; the number
    of rounds grows with the logarithm of the largest component. A round is two aggregations and
    two joins, which combine and split hot nodes; the links of a round are written to the
    checkpoint folder, so a lost executor repeats one round at most.
    """
    links = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        # Larger neighbours of u go to the least node around u.
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = split_join(both.where(F.col("v") > F.col("u")), least, ["u"]).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Smaller neighbours of u, and u itself, go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, ["u"]).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where(F.col("u") != F.col("v")).distinct()
        links = stored(small)
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    members = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(members.select("root", "root").distinct())
