"""Incidents and their evidence: correlate, group, report.

Table shapes used below:

* ``incidents``: incident_id, source_ips, timewindow, threat_level, start_time, end_time
* ``links``: incident_id, pos, event_id - one row per entry of an incident's event list
* ``linked``: links with the event's severity, start_time, description, target_ips, target_ports

Files may list an incident id more than once. Readers give each record a key of its own, ``record``;
where the tables have it, records with one id stay apart in everything below.

Joins are left to Spark, which splits the rows of a hot key in sort-merge joins by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions import alerts as A
from alertloom.functions import text as X
from alertloom.functions import times as T
from alertloom.operators.skew import ordered_text
from alertloom.session import stored
from alertloom.sources.alerts import last_events

def record_keys(df: DataFrame) -> list[str]:
    """What tells the incidents of a table apart."""
    return [c for c in ("record", "incident_id") if c in df.columns]


def group_keys(df: DataFrame) -> list[str]:
    return [*record_keys(df), "severity", "target_summary"]


def explode_links(incidents: DataFrame, scope: str = "global") -> DataFrame:
    """One row per listed event, places and repeats kept."""
    keys = record_keys(incidents) if scope == "global" else ["source_file", *record_keys(incidents)]
    return incidents.select(*keys, F.posexplode("correl_ids").alias("pos", "event_id"))


def _event_keys(scope: str) -> list[str]:
    return ["event_id"] if scope == "global" else ["source_file", "event_id"]


def _newest(events: DataFrame, scope: str) -> DataFrame:
    """Without a line order the events are taken to be unique by key."""
    return last_events(events, scope) if "line_order" in events.columns else events


def link_events(links: DataFrame, events: DataFrame, scope: str = "global") -> DataFrame:
    """Events of each incident in list order. Scope ``file`` only looks inside the same file."""
    return links.join(_newest(events, scope), _event_keys(scope))


def missing_events(links: DataFrame, events: DataFrame, scope: str = "global") -> DataFrame:
    """Listed events that do not exist."""
    known = _newest(events, scope).select(*_event_keys(scope))
    return links.join(known, _event_keys(scope), "left_anti")


def link_counts(links: DataFrame, events: DataFrame, scope: str = "global") -> DataFrame:
    """Per incident: listed, found and missing events."""
    keys = record_keys(links) if scope == "global" else ["source_file", *record_keys(links)]
    known = _newest(events, scope).select(*_event_keys(scope), F.lit(True).alias("known"))
    tried = links.join(known, _event_keys(scope), "left")
    return tried.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_event_ids"),
        F.count("known").alias("num_events"),
        F.count_if(F.col("known").isNull()).alias("missing_events"),
    )


def find_incident(incidents: DataFrame, incident_id: str) -> DataFrame:
    """The incident with this id; the absence of one is an error (this runs a small job)."""
    found = incidents.where(F.col("incident_id") == incident_id)
    if found.isEmpty():
        raise LookupError(f"no incident {incident_id!r}")
    return found


def description_counts(linked: DataFrame) -> DataFrame:
    """Events counted by incident, severity, target and description: the base of the groups."""
    short = F.nullif(T.format_time(F.col("start_time"), short=True), F.lit(""))
    at = T.wall_clock(F.col("start_time"))
    target = A.target_summary(F.col("target_ips"), F.col("target_ports"), F.col("description"))
    return (
        linked.select(*record_keys(linked), "severity", "pos", "description", short.alias("short"),
                      at.alias("at"), target.alias("target_summary"))
        .groupBy(*group_keys(linked), "description")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("pos").alias("first_pos"),
            F.min("short").alias("first_time"),
            F.max("short").alias("last_time"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
        )
    )


def incident_groups(linked: DataFrame) -> DataFrame:
    """Groups by severity and target. Sort by severity_rank descending, then first_pos.

    ``time_range`` compares clock times as text and so turns around at midnight; ``first_at`` and
    ``last_at`` are the true ends.
    """
    return groups_of(description_counts(linked))


def groups_of(counts: DataFrame) -> DataFrame:
    return (
        counts.groupBy(*group_keys(counts))
        .agg(
            F.sum("copies").alias("events"),
            F.count(F.lit(1)).alias("descriptions"),
            F.min("first_pos").alias("first_pos"),
            F.min("first_time").alias("first_time"),
            F.max("last_time").alias("last_time"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
        )
        .withColumn("time_range", T.time_range(F.col("first_time"), F.col("last_time")))
        .withColumn("severity_rank", A.severity_rank(F.col("severity")))
        .drop("first_time", "last_time")
    )


def group_examples(counts: DataFrame, examples: int = 3) -> DataFrame:
    """The most frequent descriptions of each group, earlier ones first among equals."""
    order = Window.partitionBy(*group_keys(counts)).orderBy(F.desc("copies"), "first_pos")
    return counts.withColumn("example", F.row_number().over(order)).where(
        F.col("example") <= examples
    )


def severity_breakdown(groups: DataFrame) -> DataFrame:
    """Per incident ``High: 7, Medium: 3`` with the most severe first, and the number of events."""
    keys = record_keys(groups)
    by_severity = groups.groupBy(*keys, "severity").agg(
        F.sum("events").alias("events"), F.min("first_pos").alias("first_pos")
    )
    entry = F.struct(
        (-A.severity_rank(F.col("severity"))).alias("rank"),
        "first_pos",
        F.concat_ws(": ", "severity", F.col("events").cast("string")).alias("text"),
    )
    return by_severity.groupBy(*keys).agg(
        F.sum("events").alias("event_count"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ", "
        ).alias("breakdown"),
    )


def incident_header(incidents: DataFrame) -> DataFrame:
    """The descriptive fields of an incident as they appear in reports and prompts."""
    return incidents.select(
        *record_keys(incidents),
        A.first_address(F.col("source_ips")).alias("source_ip"),
        F.coalesce(F.col("timewindow").cast("string"), F.lit("Unknown")).alias("timewindow"),
        F.coalesce(F.col("threat_level").cast("string"), F.lit("Unknown")).alias("threat_text"),
        F.coalesce(F.col("threat_level").try_cast("double"), F.lit(0.0)).alias("threat_level"),
        T.format_time(F.col("start_time")).alias("started"),
        T.format_time(F.col("end_time")).alias("ended"),
        T.timeline(F.col("start_time"), F.col("end_time")).alias("timeline"),
    )


def incident_report(incidents: DataFrame, linked: DataFrame, max_examples: int = 3) -> DataFrame:
    """One record per incident with its grouped, most-severe-first text.

    The counted descriptions are written out once; all that follows reads them instead of the
    events.
    """
    keys = record_keys(incidents)
    counts = stored(description_counts(linked))
    groups = groups_of(counts)
    header = incident_header(incidents).join(severity_breakdown(groups), keys, "left")

    example = F.struct(
        "example",
        F.when(F.col("copies") > 1, F.format_string("  - %s (x%d)", "description", "copies"))
        .otherwise(F.concat(F.lit("  - "), "description")).alias("text"),
        "first_time", "last_time", "first_at", "last_at",
    )
    examples = group_examples(counts, max_examples).groupBy(*group_keys(counts)).agg(
        F.transform(F.array_sort(F.collect_list(example)), lambda e: e["text"]).alias("examples")
    )
    summary = F.when(F.col("events") == 1, F.concat(F.lit("Event to "), "target_summary")) \
        .otherwise(F.format_string("%d events to %s", "events", "target_summary"))
    first_line = F.format_string("• %s - %s [%s]", F.col("time_range"), summary, F.upper("severity"))
    more = F.when(
        F.col("descriptions") > max_examples,
        F.array(F.format_string("  - ... and %d more variations",
                                F.col("descriptions") - max_examples)),
    ).otherwise(F.array().cast("array<string>"))
    blocks = groups.join(examples, group_keys(groups)).select(
        *keys, F.lit(1).alias("section"), (-F.col("severity_rank")).alias("rank"), "first_pos",
        F.array_join(F.concat(F.array(first_line), F.col("examples"), more), "\n").alias("line"),
    )

    known = F.col("event_count").isNotNull()
    when = F.when(F.col("ended") != "", F.concat(F.lit("Timeline: "), "timeline")) \
        .otherwise(F.concat(F.lit("Start Time: "), "started"))
    opening = F.concat_ws(
        "\n", F.lit("=" * 60), F.concat(F.lit("Incident: "), "incident_id"),
        F.format_string("Source IP: %s | Timewindow: %s", "source_ip", "timewindow"), when,
        F.format_string("Threat Level: %s | Events: %d", "threat_text", "event_count"), F.lit(""),
    )
    nothing = F.format_string("Incident %s: No associated events found", "incident_id")
    closing = F.concat_ws(
        "\n", F.lit(""), F.format_string("Total Evidence: %d events", "event_count"),
        F.concat(F.lit("Severity breakdown: "), "breakdown"),
    )

    def edge(section: int, line: Column) -> DataFrame:
        return header.select(*keys, F.lit(section).alias("section"), F.lit(0).alias("rank"),
                             F.lit(0).cast("bigint").alias("first_pos"), line.alias("line"))

    lines = (
        blocks.withColumn("first_pos", F.col("first_pos").cast("bigint"))
        .unionByName(edge(0, F.when(known, opening).otherwise(nothing)))
        .unionByName(edge(2, F.when(known, closing)).where(F.col("line").isNotNull()))
    )
    texts = ordered_text(lines, keys, ["section", "rank", "first_pos"], "line")
    return texts.join(header, keys).select(
        *keys, "source_ip", "timewindow", "timeline", "threat_level",
        F.coalesce("event_count", F.lit(0)).alias("event_count"), F.col("text").alias("analysis"),
    )


def pattern_groups(linked: DataFrame, sample_events: int = 3, max_samples: int = 5,
                   slots: int = 32) -> DataFrame:
    """Events of an incident that differ only in addresses, ports and numbers.

    Sort by events descending, time_range, first_pos. The sample values come from the first
    ``sample_events`` events by start time. ``raw_chars`` is the length of the events' own lines.

    The events are read and shuffled once: each group is first worked out in ``slots`` parts, by a hash of
    the place, and a part gives one row.
    """
    keys = [*record_keys(linked), "pattern"]
    first = max(sample_events, 1)
    events = linked.select(
        *record_keys(linked), "pos", "start_time", "description",
        X.normalise_pattern(F.col("description")).alias("pattern"),
        F.length(raw_evidence_line()).alias("chars"),
        F.pmod(F.xxhash64("pos"), F.lit(slots)).alias("slot"),
    )
    earliest = Window.partitionBy(*keys, "slot").orderBy("start_time", "pos")
    early = F.when(F.row_number().over(earliest) <= first, F.struct("start_time", "pos", "description"))
    parts = events.withColumn("early", early).groupBy(*keys, "slot").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("chars").alias("raw_chars"),
        F.min("pos").alias("first_pos"),
        F.min("start_time").alias("first_start"),
        F.max("start_time").alias("last_start"),
        F.collect_list("early").alias("early"),
    )
    whole = parts.groupBy(*keys).agg(
        F.sum("events").alias("events"),
        F.sum("raw_chars").alias("raw_chars"),
        F.min("first_pos").alias("first_pos"),
        F.min("first_start").alias("first_start"),
        F.max("last_start").alias("last_start"),
        F.slice(F.array_sort(F.flatten(F.collect_list("early"))), 1, first).alias("early"),
    )
    taken = F.slice("early", 1, sample_events)
    values = F.flatten(F.transform(taken, lambda e: X.sample_values(e["description"])))
    times = [T.format_time(F.col(c), short=True) for c in ("first_start", "last_start")]
    return whole.select(
        *keys, "events", "raw_chars", "first_pos", T.time_range(*times).alias("time_range"),
        F.slice(F.array_distinct(values), 1, max_samples).alias("samples"),
        F.col("early")[0]["description"].alias("description"),
    )


def pattern_line(groups: DataFrame) -> Column:
    """``range | description (Nx similar, samples: ..)`` or just range and description for one."""
    shown = F.when(F.size("samples") > 0, F.array_join("samples", ", ")).otherwise("various")
    several = F.format_string("%s | %s (%dx similar, samples: %s)", F.col("time_range"),
                              F.col("description"), F.col("events"), shown)
    return F.when(F.col("events") == 1, F.concat_ws(" | ", "time_range", "description")) \
        .otherwise(several)


def evidence_text(groups: DataFrame) -> DataFrame:
    """Evidence for a prompt from pattern groups, largest group first."""
    keys = record_keys(groups)
    lines = groups.select(
        *keys, (-F.col("events")).alias("fewer"), "time_range", "first_pos",
        pattern_line(groups).alias("line"),
    )
    return ordered_text(lines, keys, ["fewer", "time_range", "first_pos"], "line")


def raw_evidence_line() -> Column:
    return F.concat_ws(" | ", T.format_time(F.col("start_time"), short=True), "description")


def raw_evidence_text(linked: DataFrame, range_width: int = 10_000) -> DataFrame:
    """Every event as ``HH:MM | description`` in list order, one text per incident.

    Lines are joined within ranges of places first, so that a long list is sorted in many tasks and
    only its finished stretches meet. For texts too long for one value see ``skew.numbered_lines``.
    """
    keys = record_keys(linked)
    lines = linked.select(*keys, "pos", F.floor(F.col("pos") / range_width).alias("stretch"),
                          raw_evidence_line().alias("line"))
    stretches = ordered_text(lines, [*keys, "stretch"], ["pos"], "line")
    return ordered_text(stretches.withColumnRenamed("lines", "n"), keys, ["stretch"], "text").drop("lines").join(
        stretches.groupBy(*keys).agg(F.sum("lines").alias("lines")), keys)


def size_reduction(groups: DataFrame, linked: DataFrame | None = None,
                   tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """How much shorter grouping makes the evidence, in lines and characters (line ends included).

    With ``linked`` and ``tokens``, an expression that counts the tokens of a line, also in tokens.
    """
    keys = record_keys(groups)
    measured = groups.groupBy(*keys).agg(
        F.sum("events").alias("events"),
        (F.sum("raw_chars") + F.sum("events") - 1).alias("raw_chars"),
        F.count(F.lit(1)).alias("patterns"),
        (F.sum(F.length(pattern_line(groups))) + F.count(F.lit(1)) - 1).alias("grouped_chars"),
    ).withColumn("saved_percent", 100.0 * (1 - F.col("grouped_chars") / F.col("raw_chars")))
    if tokens is None:
        return measured
    raw = linked.select(*keys, tokens(raw_evidence_line()).alias("n")).groupBy(*keys).agg(F.sum("n").alias("raw_tokens"))
    short = groups.select(*keys, tokens(pattern_line(groups)).alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("grouped_tokens"))
    return measured.join(raw, keys).join(short, keys).withColumn(
        "saved_tokens_percent", 100.0 * (1 - F.try_divide("grouped_tokens", "raw_tokens")))


def source_summary(events: DataFrame) -> DataFrame:
    """Per source address: events, distinct targets, severities seen and hours between ends.

    Every target of an event counts.
    """
    seconds = F.timestamp_diff("SECOND", F.min("at"), F.max("at"))
    by_source = events.select(
        F.explode("source_ips").alias("source_ip"), "target_ips", "severity",
        T.wall_clock(F.col("start_time")).alias("at"))
    targets = by_source.select("source_ip", F.explode("target_ips").alias("target")).distinct() \
        .groupBy("source_ip").agg(F.count(F.lit(1)).alias("unique_targets"))
    return by_source.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("severity").alias("severities"),
        (seconds / 3600.0).alias("hours"),
    ).join(targets, "source_ip", "left").withColumn(
        "unique_targets", F.coalesce("unique_targets", F.lit(0)))


def source_event_types(events: DataFrame) -> DataFrame:
    """Per source address and normalised description: number of events."""
    return (
        events.select(F.explode("source_ips").alias("source_ip"),
                      X.normalise_pattern(F.col("description")).alias("event_type"))
        .groupBy("source_ip", "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )
