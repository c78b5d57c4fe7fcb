"""Requests matched against a feed that may change while the stream runs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.operators.feeds import feed_changes, feed_table, match_feed
from alertloom.session import package_on_workers
from alertloom.sources.alerts import with_line_numbers


def _snapshot(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{out}/feed/batch={batch_id}")
    except AnalysisException:
        return None


def match_batch(batch: DataFrame, batch_id: int, read_feed: Callable[[], DataFrame], out: str,
                uri_col: str = "uri") -> None:
    """Match one batch with the feed as it is now; write matches, the feed and its changes.

    Everything goes to folders of this batch id and replaces what an earlier try left there, so a
    batch that is run again counts once.
    """
    spark = batch.sparkSession
    feed_table(read_feed()).write.mode("overwrite").parquet(f"{out}/feed/batch={batch_id}")
    feed = spark.read.parquet(f"{out}/feed/batch={batch_id}")
    before = _snapshot(spark, out, batch_id - 1) if batch_id > 0 else None
    changes = feed_changes(before if before is not None else feed.limit(0), feed)
    changes.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")
    match_feed(batch, feed, uri_col).write.mode("overwrite").parquet(f"{out}/matches/batch={batch_id}")


def stream_match(uris: DataFrame, read_feed: Callable[[], DataFrame], out: str, checkpoint: str,
                 uri_col: str = "uri", available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Start matching a stream of requests. The feed is read anew for every batch."""
    writer = uris.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: match_batch(batch, batch_id, read_feed, out, uri_col))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


CHANGES = "regex string, description string, change string, version long"
STATE = "description string, version long"


def _pattern_changes(key, frames, state):
    """Changes of one pattern, from the versions of the feed that name it and, on a timeout, from a version that does not."""
    regex, out = key[0], []
    last = state.get if state.exists else None
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(regex, last[0], "REMOVED", last[1] + 1)], columns=["regex", "description", "change", "version"])
        return
    rows = pd.concat(list(frames), ignore_index=True)
    for row in rows.sort_values(["version", "line"], kind="stable").groupby("version").tail(1).itertuples():
        if last is not None and row.version <= last[1]:
            continue  # a version that was seen before
        if last is not None and row.version > last[1] + 1:
            out.append((regex, last[0], "REMOVED", last[1] + 1))
            last = None
        if last is None:
            out.append((regex, row.description, "NEW", row.version))
        elif row.description != last[0]:
            out.append((regex, row.description, "CHANGED", row.version))
        last = (row.description, int(row.version))
    if last is not None:
        state.update(last)
        # Due as soon as a later version has been read and did not name the pattern.
        state.setTimeoutTimestamp(last[1] * 1000 + 1)
    yield pd.DataFrame(out, columns=["regex", "description", "change", "version"])


def stream_changes(versions: DataFrame) -> DataFrame:
    """Changes of a feed out of a stream of its versions: ``regex``, ``description``, ``change``, ``version``.

    ``versions`` (streaming): ``version`` (1, 2, .. without gaps), ``regex``, ``description``, ``line``; each version names all
    patterns of the feed then. Of each pattern a state of its description and last version is kept, in
    place of snapshots that are compared; a version is an event time, and a pattern that a version no
    longer names times out as soon as that version has been read. So a removal comes a batch after the version,
    or with the batch without data that follows the last one. A batch that is run again, or a version
    that comes twice, gives no change twice. For output in append mode.
    """
    package_on_workers(versions.sparkSession)
    at = F.timestamp_seconds(F.col("version")).alias("at")
    timed = versions.where(F.col("regex").isNotNull()).select(
        "regex", F.coalesce("description", F.lit("")).alias("description"), F.col("version").cast("long").alias("version"),
        F.col("line").cast("long").alias("line"), at).withWatermark("at", "0 seconds")
    return timed.groupBy("regex").applyInPandasWithState(_pattern_changes, CHANGES, STATE, "append", "EventTimeTimeout")


def stream_series(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Readings from a folder to which closed files are added, as (series, x, y)."""
    readings = spark.readStream.schema("x double, y double").option("header", True) \
        .option("enforceSchema", True).option("maxFilesPerTrigger", max_files).csv(folder)
    return readings.select(
        F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("series"), "x", "y")


MARKS = "file string, lines long"


def _marks(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """Up to which line each file was read by a batch; None before the first and of a batch that did not get so far."""
    try:
        return spark.read.schema(MARKS).parquet(f"{out}/lines/batch={batch_id}") if batch_id >= 0 else None
    except AnalysisException:
        return None


def _file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_size").alias("size"), F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_order"))
    return rows.withColumn("bytes", F.octet_length("value") + 1)


def whole_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file`` and its number of ``lines`` that a line feed ends. Of a last line without one, the bytes with a line feed exceed the file's."""
    return _file_lines(spark, paths).groupBy("line_order.file").agg(
        (F.count(F.lit(1)) - F.when(F.sum("bytes") > F.max("size"), 1).otherwise(0)).alias("lines"))


def read_appended(spark: SparkSession, paths: str | list[str], out: str, batch_id: int) -> None:
    """What was appended to series files since the batch before, as (series, x, y) in ``out/rows/batch=..``.

    The first line of a file is its header; a last line that nothing ends yet is held back. How many lines of each file a batch
    covers is written before its rows, so that a batch which is run again covers the same lines and each
    reading arrives once. Batches are numbered from 0 without gaps. Files are scanned anew by each batch, a sum a file is kept.
    """
    own = _marks(spark, out, batch_id)
    if own is None:
        whole_lines(spark, paths).write.mode("overwrite").parquet(f"{out}/lines/batch={batch_id}")
        own = _marks(spark, out, batch_id)
    before = _marks(spark, out, batch_id - 1)
    before = spark.createDataFrame([], MARKS) if before is None else before
    bounds = own.join(before.withColumnRenamed("lines", "done"), "file", "left").select("file", F.greatest(F.coalesce("done", F.lit(0)), F.lit(1)).alias("done"), "lines")
    lines = _file_lines(spark, paths)
    numbered = with_line_numbers(lines, lines).withColumn("file", F.col("line_order.file"))
    fresh = numbered.join(bounds, "file").where((F.col("line_num") > F.col("done")) & (F.col("line_num") <= F.col("lines")))
    text = F.btrim("value", F.lit(" \t\r"))
    cells = F.from_csv(text, "x double, y double", {"mode": "PERMISSIVE"})
    fresh.where(text != "").select(F.substring_index("file", "/", -1).alias("series"), cells.alias("c")).select("series", "c.x", "c.y") \
        .write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")


def follow_series(spark: SparkSession, paths: str | list[str], out: str, checkpoint: str, interval: str = "10 seconds") -> StreamingQuery:
    """Read what is appended to the files every ``interval``, by ``read_appended``; goes on from its checkpoint where it stopped."""
    clock = spark.readStream.format("rate").load()
    return clock.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(
        lambda batch, batch_id: read_appended(batch.sparkSession, paths, out, batch_id)).start()
