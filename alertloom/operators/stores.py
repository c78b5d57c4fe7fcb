"""What is kept between runs: replies of a model, merged datasets, summaries by day.

Stores are folders of the caller, shared by the cluster. New data is reduced and added; what is stored is not shuffled again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import times as T
from alertloom.operators.datasets import METADATA_DEFAULTS
from alertloom.operators.prompts import apply_model

# Digits of the sketches of targets: 4,096 registers, a standard error of 1.6 %.
SKETCH_DIGITS = 12


def finished_parts(spark: SparkSession, path: str) -> list[str]:
    """Folders below ``path`` whose writing came to its end. What a killed run left behind is not among them."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(status.getPath().getParent().toString() for status in found)


REPLIES = "prompt_key string, prompt string, reply string, error string, asked long"


def stored_replies(spark: SparkSession, path: str) -> DataFrame:
    """The replies that a store holds, for each prompt one: an answer if there is one, else the last failure."""
    parts = finished_parts(spark, path)
    rows = spark.read.schema(REPLIES).parquet(*parts) if parts else spark.createDataFrame([], REPLIES)
    best = F.max_by(F.struct("reply", "error"), F.struct(F.col("error").isNull().alias("answered"), "asked"))
    return rows.groupBy("prompt_key").agg(best.alias("r")).select("prompt_key", "r.*")


def ask_once(df: DataFrame, prompt_col: str, model: Callable[[str], str], path: str, slices: int = 16, on_error: str = "keep",
             failure: str = "query failed: {error}") -> DataFrame:
    """``apply_model`` with a store of replies: adds ``reply`` and ``error``, and asks for no prompt that was answered before.

    Equal prompts are asked once. Prompts are dealt to ``slices`` by their hash; each slice drops what the store answers,
    asks for the rest, and is added to the store as a whole, so that a run that is killed and repeated asks only
    for the slices it had not finished. Failed prompts are asked again by the next run. A null prompt gets a null reply.
    """
    spark = df.sparkSession
    key = F.sha2(F.col(prompt_col).cast("binary"), 256)
    wanted = df.where(F.col(prompt_col).isNotNull()).select(key.alias("prompt_key"), F.col(prompt_col).alias("prompt")).distinct()
    for k in range(slices):
        answered = stored_replies(spark, path).where("error IS NULL").select("prompt_key")
        rest = wanted.where(F.pmod(F.xxhash64("prompt_key"), F.lit(slices)) == k).join(answered, "prompt_key", "left_anti")
        asked = apply_model(rest, "prompt", model, "keep", failure).withColumn("asked", F.lit(time.time_ns()))
        asked.select("prompt_key", "prompt", "reply", "error", "asked").write.parquet(f"{path.rstrip('/')}/{time.time_ns()}-{uuid.uuid4().hex[:8]}")
    replies = stored_replies(spark, path).withColumnRenamed("prompt_key", "_key")
    whole = df.withColumn("_key", key).join(replies, "_key", "left").drop("_key")
    return whole if on_error == "keep" else whole.where(F.col("error").isNull())


class MergeStore:
    """Records of many producers, bucketed by incident, to which files are added.

    Each ``add`` reduces its records to one for an incident and producer and appends them to their buckets; only
    the new records are shuffled. ``merged`` and ``correlated`` read the buckets as they lie: of an incident the first
    record in file order counts, of a producer's payloads the last, as in ``merge_first`` and ``correlate``.
    """

    SCHEMA = ("incident_id string, analysis_type string, payload map<string,string>, first_place struct<file_order:int,pos:bigint>, "
              "last_place struct<file_order:int,pos:bigint>, meta struct<category:string,source_ip:string,timewindow:string,timeline:string,"
              "threat_level:double,event_count:bigint>, record string")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.table = spark, f"merge_store_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (incident_id) SORTED BY (incident_id) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
        self.buckets = buckets

    def add(self, records: DataFrame) -> None:
        """``records``: incident_id, analysis_type, payload, the metadata fields, file_order, pos, and any others."""
        meta = F.struct(*[F.coalesce(F.col(c), F.lit(v)).cast({"threat_level": "double", "event_count": "bigint"}.get(c, "string")).alias(c)
                          for c, v in METADATA_DEFAULTS.items()])
        place = F.struct(F.col("file_order").cast("int").alias("file_order"), F.col("pos").cast("bigint").alias("pos"))
        whole = F.to_json(F.struct(*[c for c in records.columns if c not in ("file_order", "pos", "payload", "analysis_type")]))
        rows = records.where(F.coalesce(F.col("incident_id").cast("string"), F.lit("")) != "").select(
            F.col("incident_id").cast("string").alias("incident_id"), "analysis_type", "payload", place.alias("_place"), meta.alias("_meta"), whole.alias("_whole"))
        reduced = rows.groupBy("incident_id", "analysis_type").agg(
            F.max_by("payload", "_place").alias("payload"), F.min("_place").alias("first_place"), F.max("_place").alias("last_place"),
            F.min_by("_meta", "_place").alias("meta"), F.min_by("_whole", "_place").alias("record"))
        dealt = reduced.repartition(self.buckets, "incident_id")
        names = [c.name for c in self.spark.table(self.table).schema]
        dealt.select(*names).write.insertInto(self.table)

    def merged(self) -> DataFrame:
        """For each incident its first record, as JSON."""
        return self.spark.table(self.table).groupBy("incident_id").agg(
            F.min_by("record", "first_place").alias("record"), F.min("first_place").alias("place"))

    def correlated(self) -> DataFrame:
        """One row per incident: metadata of its first record, each producer's last payload. A second grouping by producer
        stays within the buckets."""
        rows = self.spark.table(self.table).groupBy("incident_id", "analysis_type").agg(
            F.max_by("payload", "last_place").alias("payload"), F.min("first_place").alias("first_place"), F.min_by("meta", "first_place").alias("meta"))
        return rows.groupBy("incident_id").agg(
            F.min_by("meta", "first_place").alias("meta"), F.map_from_entries(F.collect_list(F.struct("analysis_type", "payload"))).alias("analyses"),
        ).select("incident_id", "meta.*", "analyses")

    def close(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def daily_summary(events: DataFrame) -> DataFrame:
    """For each source address and day what merges to ``source_summary``: events, severities, first and last time, a sketch of targets."""
    by_source = events.select(
        F.explode("source_ips").alias("source_ip"), "target_ips", "severity", T.wall_clock(F.col("start_time")).alias("at"))
    by_source = by_source.withColumn("day", F.to_date("at"))
    counts = by_source.groupBy("source_ip", "day").agg(
        F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_set("severity")).alias("severities"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    targets = by_source.select("source_ip", "day", F.explode("target_ips").alias("target")).groupBy("source_ip", "day").agg(
        F.hll_sketch_agg("target", F.lit(SKETCH_DIGITS)).alias("targets"))
    same = (counts["source_ip"] == targets["source_ip"]) & counts["day"].eqNullSafe(targets["day"])
    return counts.join(targets, same, "left").select(counts["source_ip"], counts["day"], "events", "severities", "first_at", "last_at", "targets")


def write_days(summary: DataFrame, path: str) -> None:
    """Store days of ``daily_summary``, replacing those days that are stored already."""
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def summary_of_days(days: DataFrame, where: Column | None = None) -> DataFrame:
    """``source_summary`` out of stored days, without reading an event; ``unique_targets`` is an estimate with a standard
    error of 1.6 % (exact up to a few hundred)."""
    chosen = days if where is None else days.where(where)
    seconds = F.timestamp_diff("SECOND", F.min("first_at"), F.max("last_at"))
    return chosen.groupBy("source_ip").agg(
        F.sum("events").alias("events"), F.size(F.array_distinct(F.flatten(F.collect_list("severities")))).cast("long").alias("severities"),
        (seconds / 3600.0).alias("hours"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("targets")), F.lit(0)).alias("unique_targets"))
