"""Lines that many documents share: levelled sorted runs of line hashes, and documents without those lines."""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.once import evaluated_once
from alertloom.llm.common import BLANKS, text_of
from alertloom.session import new_folder, shuffle_width, stored

#: Documents that must share a line before it goes.
LEAST_DOCUMENTS = 10
#: Runs of a level that are merged into one run of the next level.
FANOUT = 2
#: Batches in which a whole table is added.
BATCHES = 4


def ascii_lower(text: Column) -> Column:
    """The text with A to Z in lower case and all other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line: without ASCII white space at its ends, A to Z in lower case."""
    return F.transform(split_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(BLANKS)))


def line_hash(key: Column) -> Column:
    """128 bits of a key, as sortable bytes."""
    return F.unhex(F.md5(key.cast("binary")))


class LineRuns:
    """Which line hashes occur in ``least`` documents or more, kept as sorted runs that grow by batches.

    A run is a table ``hash``, ``n`` (documents) of the checkpoint folder, bucketed and sorted by hash, so
    that runs are merged and joined bucket by bucket without a shuffle of what is stored. ``add`` drops
    from a batch the hashes that are settled (known to be frequent) by a merge anti-join with the
    settled run, and writes the others as a run of level 0. As soon as a level holds ``fanout`` runs
    they are merged into one run of the next; hashes that reach ``least`` there move to the settled run.
    So a hash is written once a level, and the number of runs grows with the logarithm of the batches.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCUMENTS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.least, self.fanout = spark, least, max(2, fanout)
        self.buckets = buckets or shuffle_width(spark)
        self.levels: list[list[str]] = []
        self.settled: list[str] = []

    def _run(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.select("hash", "n").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", new_folder(self.spark)).saveAsTable(name)
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        """One row for each hash of some runs, without those that are settled."""
        rows = reduce(DataFrame.unionAll, [self.spark.table(r) for r in runs])
        return self._unsettled(rows.groupBy("hash").agg(F.sum("n").alias("n")))

    def _unsettled(self, counts: DataFrame) -> DataFrame:
        for run in self.settled:
            counts = counts.join(self.spark.table(run).select("hash"), "hash", "left_anti")
        return counts

    def _dropped(self, runs: list[str]) -> None:
        """Forget runs; their files are left to the clean-up of the checkpoint folder."""
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def add(self, hashes: DataFrame) -> None:
        """Add a batch: ``hash``, once for each document that has the line."""
        own = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        self._push(0, self._run(self._unsettled(own)))

    def _push(self, level: int, run: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        whole = self._run(self._merged(runs))
        self._dropped(runs)
        self._settle(self.spark.table(whole).where(F.col("n") >= self.least))
        # Hashes that were settled now stay in this run until the next merge drops them.
        self._push(level + 1, whole)

    def _settle(self, counts: DataFrame) -> None:
        """The settled run and newly frequent hashes, as one run."""
        before = self.settled
        self.settled = [self._run(reduce(DataFrame.unionAll, [self.spark.table(r) for r in before] + [counts]))]
        self._dropped(before)

    def frequent(self) -> DataFrame:
        """The frequent hashes of all batches so far, each once. More batches may follow."""
        parts = [self.spark.table(r).select("hash") for r in self.settled]
        if runs := [r for level in self.levels for r in level]:
            parts.append(self._merged(runs).where(F.col("n") >= self.least).select("hash"))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], "hash binary")

    def close(self) -> None:
        self._dropped([*self.settled, *(r for level in self.levels for r in level)])


def line_hashes(docs: DataFrame, batches: int) -> DataFrame:
    """``batch`` and ``hash``: each line of a document once, empty keys left out."""
    keys = evaluated_once(docs.select(text_of().alias("text")), {"keys": F.array_distinct(line_keys(F.col("text")))})
    dealt = keys.select(F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int").alias("batch"), F.explode("keys").alias("key"))
    return dealt.where("key <> ''").select("batch", line_hash(F.col("key")).alias("hash"))


def frequent_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Hashes of the lines found in ``least`` rows of ``docs`` or more.

    Texts are read once: the hashes of each batch are written apart, then batch after batch is added to
    the runs. Rows that repeat are documents of their own.
    """
    spark, path = docs.sparkSession, new_folder(docs.sparkSession)
    line_hashes(docs, batches).write.partitionBy("batch").parquet(path)
    pieces = spark.read.schema("hash binary, batch int").parquet(path)
    runs = LineRuns(spark, least, fanout)
    for batch in range(batches):
        runs.add(pieces.where(F.col("batch") == batch))
    found = stored(runs.frequent())
    runs.close()
    return found


def without_frequent_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Documents without the lines whose key is found in ``least`` documents or more.

    ``docs``: ``doc_id``, ``text`` and any other columns, which are not read. A text is split at each
    line feed; null and empty texts have one empty line. A line's key is the line without ASCII white space at its
    ends, with A to Z in lower case; empty keys never go. A row counts once for a key however often
    it has the line, and rows that repeat count each. Returns a row for each row: ``doc_id``, ``n_lines``,
    ``n_dropped``, ``kept_sha256``, ``kept_text`` (what stays, joined by line feeds).

    Lines that go are found by hash: the lines of all texts, 40 bytes each, are joined with the frequent hashes
    (broadcast by Spark if it sees that they are few, else merged, hot lines split), and come
    back as one list of places for each text that has some, whatever the number of its copies.
    A text of any length is one row, as in ``docs``. An empty table gives no rows.
    """
    frequent = frequent_lines(docs, least, batches, fanout)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("_own", F.unhex(F.md5(F.col("text").cast("binary"))))
    placed = evaluated_once(rows.select("_own", "text"), {"keys": line_keys(F.col("text"))}).select(
        "_own", F.posexplode("keys").alias("place", "key"))
    hits = placed.where("key <> ''").select("_own", "place", line_hash(F.col("key")).alias("hash")).join(frequent, "hash")
    gone = stored(hits.groupBy("_own").agg(F.collect_set("place").alias("gone")))
    found = rows.join(gone, "_own", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    found = evaluated_once(found, {"lines": split_lines(F.col("text"))})
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda k: F.get(F.col("lines"), k)), "\n"))
    found = evaluated_once(found, {"kept_text": kept})
    return found.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "kept_text")
