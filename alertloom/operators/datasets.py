"""Putting analysis records of many producers together, merging datasets, checking the result.

Records carry ``incident_id``, the metadata fields, payload fields and a place:
``file_order`` (position of the file in the caller's list) and ``pos`` (position in the file).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.jsontext import is_json
from alertloom.schemas import REQUIRED_FIELDS
from alertloom.session import shuffle_width, stored

METADATA_DEFAULTS = {
    "category": "Unknown", "source_ip": "Unknown", "timewindow": "Unknown", "timeline": "Unknown",
    "threat_level": 0.0, "event_count": 0,
}
PAYLOADS = ("analysis", "summary", "behavior_analysis", "cause_analysis", "risk_assessment")

def _has_id() -> Column:
    return F.coalesce(F.col("incident_id").cast("string"), F.lit("")) != ""


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Frames one below the other, numbered by ``file_order``; absent columns become null."""
    numbered = [df.withColumn("file_order", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def category_mapping(incidents: DataFrame) -> DataFrame:
    """Category per incident id as the last line with that id says."""
    return incidents.where(_has_id()).groupBy("incident_id").agg(
        F.max_by(F.coalesce("category", F.lit("Unknown")), "line_order").alias("mapped_category")
    )


def payload(present: Column | None = None) -> Column:
    """What a record contributes, by the fields it has: cause and risk texts, a plain analysis,
    a summary with behaviour, or an empty text. ``present`` (names of the record's fields) tells
    an absent field from a null one; without it, null counts as absent."""
    def has(name: str) -> Column:
        return F.col(name).isNotNull() if present is None else F.array_contains(present, name)

    def both(first: str, second: str) -> Column:
        one = [F.lit(first), F.col(first)]
        other = [F.lit(second), F.col(second)]
        return F.when(has(first) & has(second), F.create_map(*one, *other)) \
            .when(has(first), F.create_map(*one)).otherwise(F.create_map(*other))

    return (
        F.when(has("cause_analysis") | has("risk_assessment"), both("cause_analysis", "risk_assessment"))
        .when(has("analysis"), F.create_map(F.lit("analysis"), F.col("analysis")))
        .when(has("summary") | has("behavior_analysis"), both("summary", "behavior_analysis"))
        .otherwise(F.create_map(F.lit("analysis"), F.lit("")))
    )


def correlate(records: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """One row per incident found by any producer.

    ``records`` are the stacked frames with an ``analysis_type`` and a ``payload``. Metadata comes
    from the first record of an incident, the payload of a type from its last one; a category
    mapping, if given, wins over the record's own category. ``analyses`` maps type to payload.
    Two shuffles serve any number of producers; repeats of an incident are thinned out to one row
    per task before the first.
    """
    meta = F.struct(*[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in METADATA_DEFAULTS.items()])
    place = F.struct("file_order", "pos")
    latest = (
        records.where(_has_id())
        .withColumns({"_meta": meta, "_place": place})
        .groupBy("incident_id", "analysis_type")
        .agg(
            F.max_by("payload", "_place").alias("payload"),
            F.min("_place").alias("first_place"),
            F.min_by("_meta", "_place").alias("meta"),
        )
    )
    rows = latest.groupBy("incident_id").agg(
        F.min_by("meta", "first_place").alias("meta"),
        # One entry per producer, so this list is as long as the list of inputs at most.
        F.map_from_entries(F.collect_list(F.struct("analysis_type", "payload"))).alias("analyses"),
    ).select("incident_id", "meta.*", "analyses")
    if mapping is None:
        return rows
    mapped = rows.join(mapping, "incident_id", "left")
    return mapped.withColumn("category", F.coalesce("mapped_category", "category")) \
        .drop("mapped_category")


def wide(correlated: DataFrame, types: list[str]) -> DataFrame:
    """The map of analyses as one column per type: cause-and-risk types keep their name, others
    end in ``_analysis``."""
    def name(kind: str) -> str:
        return kind if kind.startswith("cause_risk") else f"{kind}_analysis"

    return correlated.select(
        *[c for c in correlated.columns if c != "analyses"],
        *[F.try_element_at("analyses", F.lit(k)).alias(name(k)) for k in types],
    )


def merge_first(records: DataFrame, key: str = "incident_id") -> DataFrame:
    """One record per id, the first in file order; records without id are dropped."""
    rest = [c for c in records.columns if c != key]
    return (
        records.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct("file_order", "pos")).alias("r"))
        .select(key, "r.*")
    )


def sorted_merge(records: DataFrame, key: str = "incident_id") -> DataFrame:
    """``merge_first`` in order of the id, with ``pos``, the place in the output.

    The merge is range partitioned by id and written with the number of each row's partition; a
    row's place is its number in the partition after the rows of the partitions before, of which
    there are as many counts as partitions.
    """
    merged = merge_first(records, key)
    written = stored(
        merged.repartitionByRange(shuffle_width(records.sparkSession), key).withColumn("_range", F.spark_partition_id()))
    counts = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(key)
    return written.join(F.broadcast(before), "_range").withColumn(
        "pos", F.col("_before") + F.row_number().over(inside) - 1).select(merged.columns)


def id_balance(inputs: DataFrame, output: DataFrame) -> DataFrame:
    """What comparing the ids of both sides tells, from one shuffle of the ids (one row)."""
    def ids(df: DataFrame, incoming: int) -> DataFrame:
        return df.select(F.when(_has_id(), F.col("incident_id")).alias("incident_id"),
                         F.lit(incoming).alias("incoming"))

    per_id = ids(inputs, 1).unionByName(ids(output, 0)).groupBy("incident_id").agg(
        F.sum("incoming").alias("came"), F.count_if(F.col("incoming") == 0).alias("left"))
    named, came, left = F.col("incident_id").isNotNull(), F.col("came"), F.col("left")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return per_id.agg(
        total(came).alias("input_total"),
        F.count_if(named & (came > 0)).alias("unique_ids"),
        total(left).alias("output_count"),
        total(F.when(named & (left > 1), left - 1).otherwise(0)).alias("repeated"),
        F.count_if(named & (came > 0) & (left == 0)).alias("missing"),
        F.count_if(named & (came == 0) & (left > 0)).alias("extra"),
    ).withColumn("duplicates_removed", F.col("input_total") - F.col("unique_ids"))


def merge_counts(inputs: DataFrame, output: DataFrame) -> DataFrame:
    """Input records, distinct ids, output records, and how many inputs the merge removed."""
    return id_balance(inputs, output).select(
        "input_total", "unique_ids", "output_count", "duplicates_removed")


def duplicate_ids(inputs: DataFrame, first: int = 10) -> DataFrame:
    """The first ids that occur more than once, with their files and copies per file."""
    per_file = inputs.where(_has_id()).groupBy("incident_id", "source_file").agg(
        F.count(F.lit(1)).alias("copies"))
    repeated = per_file.groupBy("incident_id").agg(F.sum("copies").alias("total")) \
        .where(F.col("total") > 1).orderBy("incident_id").limit(first)
    return per_file.join(F.broadcast(repeated), "incident_id")


def completeness(inputs: DataFrame, output: DataFrame) -> DataFrame:
    """Ids on one side only: ``missing`` from the output or ``extra`` in it."""
    def ids(df: DataFrame, side: str) -> DataFrame:
        return df.where(_has_id()).select("incident_id", F.lit(side).alias("side"))

    return (
        ids(inputs, "missing").unionByName(ids(output, "extra"))
        .groupBy("incident_id")
        .agg(F.min("side").alias("side"), F.max("side").alias("other"))
        .where(F.col("side") == F.col("other"))
        .select("incident_id", "side")
    )


def inversions(rows: DataFrame, pos_col: str, id_col: str, width: int = 100_000) -> DataFrame:
    """How often an id is smaller than the one before it (one row, ``inversions``).

    Positions are cut into ranges; each range is checked by itself and handed on as its first and
    last id. Two rounds leave one row per ``width * width`` positions for the last comparison.
    """
    def fold(df: DataFrame, into: list[str]) -> DataFrame:
        order = Window.partitionBy(*into).orderBy("at")
        broken = F.lag("last").over(order) > F.col("first")
        return (
            df.withColumn("bad", F.col("bad") + F.when(broken, 1).otherwise(0))
            .groupBy(*into)
            .agg(F.sum("bad").alias("bad"), F.min_by("first", "at").alias("first"),
                 F.max_by("last", "at").alias("last"))
        )

    ids = F.coalesce(F.col(id_col), F.lit(""))
    rows = rows.select(
        (F.floor(F.col(pos_col) / width / width)).alias("outer"),
        (F.floor(F.col(pos_col) / width)).alias("inner"),
        F.col(pos_col).alias("at"), ids.alias("first"), ids.alias("last"), F.lit(0).alias("bad"),
    )
    inner = fold(rows, ["outer", "inner"]).withColumn("at", F.col("inner"))
    outer = fold(inner, ["outer"]).withColumn("at", F.col("outer"))
    return fold(outer, []).select(F.coalesce("bad", F.lit(0)).alias("inversions"))


def integrity(output: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS) -> DataFrame:
    """Missing fields, records without id and wrongly typed numbers (one row).

    With the columns ``present`` and ``raw`` of the readers, presence and types are those of the
    JSON text; otherwise a null field counts as missing and the column types as given.
    """
    if "raw" in output.columns:
        def absent(field: str) -> Column:
            return ~F.array_contains("present", field)

        record = F.when(is_json(F.col("raw")), F.try_parse_json("raw"))
        kinds = {f: F.schema_of_variant(F.try_variant_get(record, f"$.{f}", "variant"))
                 for f in ("threat_level", "event_count")}
        number = kinds["threat_level"].rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|BOOLEAN)")
        whole = kinds["event_count"].rlike("^(BIGINT|BOOLEAN|DECIMAL\\(\\d+,0\\))")
        wrong = (
            F.when(~absent("threat_level") & ~F.coalesce(number, F.lit(False)), 1).otherwise(0)
            + F.when(~absent("event_count") & ~F.coalesce(whole, F.lit(False)), 1).otherwise(0)
        )
    else:
        def absent(field: str) -> Column:
            return F.col(field).isNull()

        wrong = F.lit(0)
    missing = sum((F.when(absent(f), 1).otherwise(0) for f in required), F.lit(0))
    return output.agg(
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_fields"),
        F.count_if(~_has_id()).alias("empty_ids"),
        F.coalesce(F.sum(wrong), F.lit(0)).alias("type_errors"),
    )


def verify_merge(inputs: DataFrame, output: DataFrame, readable: bool | DataFrame = True) -> DataFrame:
    """Rows (check, passed, detail) over a merge, closed by their conjunction ``overall``.

    ``readable`` says whether all files could be read, or is a table of those that could not, a row each, such as
    ``unreadable_files`` gives; their number is the detail of the check.

    ``output`` needs a ``pos`` for the order check and should be a written table: it is read three
    times, for its ids, its fields and its order.
    """
    def row(name: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), detail.alias("detail"))

    def count(name: str) -> Column:
        return F.col(name) == 0

    bad = F.lit(0) if isinstance(readable, bool) else readable.agg(F.count(F.lit(1))).scalar()
    ids = id_balance(inputs, output).select(F.inline(F.array(
        row("files", *((F.lit(readable), F.lit("")) if isinstance(readable, bool) else (bad == 0, F.format_string("%d unreadable", bad)))),
        row("counts", F.col("output_count") == F.col("unique_ids"),
            F.format_string("%d in, %d ids, %d out, %d removed", "input_total", "unique_ids",
                            "output_count", "duplicates_removed")),
        row("no_repeats", count("repeated"), F.format_string("%d repeated", "repeated")),
        row("complete", count("missing") & count("extra"),
            F.format_string("%d missing, %d extra", "missing", "extra")),
    )))
    fields = integrity(output).select(F.inline(F.array(row(
        "integrity", count("missing_fields") & count("empty_ids") & count("type_errors"),
        F.format_string("%d missing fields, %d empty ids, %d type errors",
                        "missing_fields", "empty_ids", "type_errors")))))
    order = inversions(output, "pos", "incident_id").select(F.inline(F.array(row(
        "sorted", count("inversions"), F.format_string("%d out of order", "inversions")))))
    # Six rows; the closing row is added to them without a second look at the data.
    report = ids.unionByName(fields).unionByName(order)
    gathered = report.agg(F.collect_list(F.struct("check", "passed", "detail")).alias("rows"))
    failed = F.size(F.filter("rows", lambda r: ~r["passed"]))
    overall = row("overall", failed == 0, F.format_string("%d failed", failed))
    return gathered.select(F.inline(F.concat("rows", F.array(overall))))
