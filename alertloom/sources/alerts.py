"""Alert files: JSON lines holding incidents and the events they refer to."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.functions import alerts as A
from alertloom.functions.jsontext import END_MARK, STRICT, is_json, with_end_mark
from alertloom.functions.once import evaluated_once
from alertloom.functions.text import strip
from alertloom.schemas import ALERT_LINE

ALERT_FILE = "alerts.json"
CATEGORY_FOLDERS = ("Normal", "Malware")


class Alerts(NamedTuple):
    incidents: DataFrame
    events: DataFrame
    rejects: DataFrame
    kinds: DataFrame


def scan_lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """Lines with their file and a sortable place in it.

    Spark keeps no line numbers. Within a split the row id grows with the offset in the file, and
    splits of a file start at growing offsets, so (file, split start, row id) sorts as the file does.
    """
    reader = spark.read
    for name, value in options.items():
        reader = reader.option(name, value)
    lines = reader.text(paths)
    return lines.select(
        strip(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_order"),
    )


def parse_lines(lines: DataFrame) -> Alerts:
    """Route lines by their Status; what fits neither kind is kept with a reason. A line must be
    one JSON object and nothing else, as JSON is defined; it is parsed once. Each incident gets a ``record`` key, its
    file and place, that tells records with one id apart."""
    marked = f"{ALERT_LINE}, `{END_MARK}` int"
    options = STRICT | {"columnNameOfCorruptRecord": "_corrupt"}
    parsed = evaluated_once(
        lines.where(F.col("line") != ""), {"a": F.from_json(with_end_mark(F.col("line")), marked, options)}
    ).withColumn("status", F.coalesce("a.Status", F.lit("")))
    parsed = evaluated_once(parsed, {"n": F.from_json("a.Note", "map<string,string>", STRICT)})
    broken = F.col("a").isNull() | F.col("a._corrupt").isNotNull() | F.col(f"a.`{END_MARK}`").isNull()
    note = A.note_map(F.col("a.Note"), F.col("n"))
    common = (
        F.coalesce("a.StartTime", F.lit("")).alias("start_time"),
        note.alias("note"),
        F.col("line").alias("raw_json"),
        "source_file",
        "line_order",
    )
    incidents = parsed.where(~broken & (F.col("status") == "Incident")).select(
        F.to_json(F.struct("line_order")).alias("record"),
        F.coalesce("a.ID", F.lit("")).alias("incident_id"),
        F.col("a.Severity").alias("severity"),
        F.col("a.category").alias("category"),
        A.addresses(F.col("a.Source")).alias("source_ips"),
        F.coalesce("a.CreateTime", F.lit("")).alias("create_time"),
        F.coalesce("a.CorrelID", F.array().cast("array<string>")).alias("correl_ids"),
        *common,
    ).withColumns(incident_note(F.col("note")))
    events = parsed.where(~broken & (F.col("status") == "Event")).select(
        F.coalesce("a.ID", F.lit("")).alias("event_id"),
        F.coalesce("a.Severity", F.lit("Unknown")).alias("severity"),
        F.coalesce("a.Confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("a.Description", F.lit("")).alias("description"),
        A.addresses(F.col("a.Source")).alias("source_ips"),
        A.ports(F.col("a.Source")).alias("source_ports"),
        A.addresses(F.col("a.Target")).alias("target_ips"),
        A.ports(F.col("a.Target")).alias("target_ports"),
        *common,
    )
    reason = (
        F.when(broken & ~is_json(F.col("line")), "bad json")
        .when(broken, "bad record")
        .when(~F.col("status").isin("Incident", "Event"), "unknown status")
    )
    rejects = parsed.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "source_file", "line_order", "reason", F.col("line").alias("raw_json"))
    kinds = parsed.select(F.coalesce(reason, F.lower("status")).alias("kind"))
    return Alerts(incidents, events, rejects, kinds)


def incident_note(note: Column) -> dict[str, Column]:
    """The three note keys that reports use; absent keys stay null."""
    return {
        "timewindow": note["timewindow"],
        "threat_level": note["accumulated_threat_level"],
        "end_time": F.coalesce(note["EndTime"], F.lit("")),
    }


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``line_num``, from 1, to rows with the ``line_order`` of scanned lines.

    Lines, blank ones included, are counted per split of a file, a row each; the sum over the splits before
    (one row for each split) and the place in its own split give a line's number. ``lines`` must be what the rows
    come from, read in the same session settings.
    """
    splits = lines.groupBy("line_order.file", "line_order.block").agg(F.min("line_order.row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", (before - F.col("first") + 1).alias("_shift"))
    return rows.withColumns({"file": F.col("line_order.file"), "block": F.col("line_order.block")}).join(splits, ["file", "block"]).withColumn(
        "line_num", F.col("line_order.row") + F.col("_shift")).drop("file", "block", "_shift")


def _numbered(lines: DataFrame) -> Alerts:
    alerts = parse_lines(lines)
    return alerts._replace(rejects=with_line_numbers(alerts.rejects, lines))


def read_alerts(spark: SparkSession, paths: str | list[str]) -> Alerts:
    """Incidents, events, what was rejected with its line number, and the kinds of all lines."""
    return _numbered(scan_lines(spark, paths))


def discover_alerts(spark: SparkSession, base: str, category: str | None = None) -> Alerts:
    """Every alert file below the category folders of ``base``; the category prunes folders."""
    if category is None:
        folders = CATEGORY_FOLDERS
    else:
        folders = tuple(f for f in CATEGORY_FOLDERS if f.lower() == category.lower())
        if not folders:
            raise ValueError(f"category must be one of {CATEGORY_FOLDERS}, not {category!r}")
    pattern = f"{base.rstrip('/')}/{{{','.join(folders)}}}"
    return _numbered(scan_lines(spark, pattern, recursiveFileLookup="true", pathGlobFilter=ALERT_FILE))


def path_metadata(df: DataFrame, root: str, file_col: str = "source_file") -> DataFrame:
    """Category, dataset, capture and time window from the four folders below ``root``."""
    parts = F.split(F.url_decode(F.replace(F.col(file_col), F.lit("+"), F.lit("%2B"))), "/")
    at = F.array_position(parts, root)
    names = ("path_category", "path_dataset", "path_capture", "path_timewindow")
    return df.withColumns({
        name: F.when(at > 0, F.try_element_at(parts, (at + depth).cast("int")))
        for depth, name in enumerate(names, 1)
    }).fillna("unknown", list(names))


def parse_counts(alerts: Alerts) -> DataFrame:
    """How many lines of each kind were read."""
    return alerts.kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))


def last_events(events: DataFrame, scope: str = "global") -> DataFrame:
    """One event per ID, the one read last. Scope ``file`` keeps IDs apart by file and drops
    events without ID; scope ``global`` keeps those under the empty ID."""
    keys = ["event_id"] if scope == "global" else ["source_file", "event_id"]
    if scope == "file":
        events = events.where(F.col("event_id") != "")
    rest = [c for c in events.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col("line_order")).alias("e")
    return events.groupBy(*keys).agg(newest).select(*keys, "e.*")
