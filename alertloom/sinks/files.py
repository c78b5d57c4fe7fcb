"""Files in the layouts other tools expect. Every writer works in parallel, one file per task,
unless ``single`` asks for one file, which is meant for small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_category(raw: Column, category: Column) -> Column:
    """A JSON object's text with a field ``category`` of its own: a top-level one is replaced, nested ones stay, else it is added
    at the end. Fields and their texts stay as they are. Text that is no object gets the field before its last brace."""
    value = F.regexp_replace(F.to_json(F.array(category)), r"^\[|\]$", "")
    head = F.regexp_replace(raw, r"\}\s*\z", "")
    comma = F.when(head.rlike(r"\{\s*\z"), "").otherwise(", ")
    added = F.concat(head, comma, F.lit('"category": '), value, F.lit("}"))
    own = F.coalesce(F.array_contains(F.json_object_keys(raw), "category"), F.lit(False))
    # The pieces between strings tell how deep a string lies: depth is counted over their brackets.
    strings = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*+"'), F.lit(0))
    between = F.split(raw, r'"(?:[^"\\]|\\.)*+"', -1)

    def count(text: Column, chars: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, chars, ""))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit(False).alias("skip"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        gap, string = piece["0"], piece["1"]
        depth = a["depth"] + count(gap, "{[") - count(gap, "}]")
        # A value that is replaced ends at the first comma or closing brace of the outer object.
        ends = a["skip"] & ((depth < 1) | ((depth == 1) & gap.rlike(r"[,}]")))
        after = F.when(depth < 1, F.regexp_extract(gap, r"(\s*\}[^}]*)\z", 1)).otherwise(F.regexp_extract(gap, r"(,[^,]*)\z", 1))
        shown = F.when(a["skip"], F.when(ends, after).otherwise("")).otherwise(gap)
        skipping = a["skip"] & ~ends
        here = ~skipping & ~a["done"] & (depth == 1) & (string == '"category"') & gap.rlike(r"[{,]\s*\z")
        text = F.concat(a["text"], shown, F.when(skipping, "").when(here, F.concat(F.lit('"category": '), value)).otherwise(F.coalesce(string, F.lit(""))))
        return F.struct(text.alias("text"), depth.alias("depth"), (skipping | here).alias("skip"), (a["done"] | here).alias("done"))

    replaced = F.aggregate(F.arrays_zip(between.alias("0"), strings.alias("1")), start, step, lambda a: a["text"])
    return F.when(own, replaced).otherwise(added)


def sample_rows(sample: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """The lines of a sample file: each incident, its category put in, then its events. An event of two incidents appears
    under both.

    ``sample``: source_file, incident_id, raw_json, category, and ``sample_order`` if the sample has an order of its own; lines
    are sorted by it, then by incident_id and pos. ``links`` and ``events`` as read with file scope.
    """
    keys = ["source_file", "incident_id"]
    order = ["sample_order"] if "sample_order" in sample.columns else []
    first = sample.select(*order, *keys, F.lit(-1).cast("bigint").alias("pos"), with_category(F.col("raw_json"), F.col("category")).alias("line"))
    chosen = links.join(sample.groupBy(*keys).agg(F.min("sample_order").alias("sample_order")) if order else sample.select(*keys).distinct(), keys)
    found = chosen.join(events.select("source_file", "event_id", F.col("raw_json").alias("line")),
                        ["source_file", "event_id"])
    return first.unionByName(found.select(*order, *keys, F.col("pos").cast("bigint").alias("pos"), "line"))


def write_sample(rows: DataFrame, path: str) -> None:
    """Lines of an incident stay together and in order, incidents in the sample's order: a range partitioning over all sort keys
    cuts a very long incident across neighbouring files instead of piling it up in one."""
    keys = [c for c in ("sample_order", "source_file", "incident_id", "pos") if c in rows.columns]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line") \
        .write.mode("overwrite").text(path)


def _arranged(df: DataFrame, order: list[str] | None, single: bool) -> DataFrame:
    if order:
        df = df.orderBy(*order)
    return df.coalesce(1) if single else df


def write_records(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """JSON lines. Chats, statistics and analysis records all go this way."""
    _arranged(df, order, single).write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str, order: list[str], wrapped: bool = False,
                        single: bool = False) -> None:
    """One JSON array, or an object that wraps it with its count, written in parallel.

    The part files in name order make up the document: it opens in the first and closes in the last.
    ``single`` writes it as one file, for tools that need one; all records pass one task then.
    """
    total = df.agg(F.count(F.lit(1))).first()[0]
    open_text = f'{{"total_incidents": {total}, "incidents": [' if wrapped else "["
    names = [f"_o{i}" for i in range(len(order))]
    records = df.select(
        F.lit(1).alias("_part"), *[F.col(c).alias(n) for c, n in zip(order, names)],
        F.xxhash64(*df.columns).alias("_tie"), F.to_json(F.struct(*df.columns)).alias("line"))
    edges = df.sparkSession.createDataFrame([(0, open_text), (2, "]}" if wrapped else "]")], "_part int, line string")
    lines = records.unionByName(edges, allowMissingColumns=True)
    keys = ["_part", *names, "_tie"]
    # Every record but the last ends its line with a comma. Rows equal to the last are told apart by number.
    # The last place is found without the texts, then counted, with its line.
    last = records.agg(F.max(F.struct(*keys)).alias("k")).first()["k"]
    if last is not None:
        at_end = F.struct(*keys).eqNullSafe(F.struct(*[F.lit(last[c]) for c in keys]))
        end = records.where(at_end).agg(F.count(F.lit(1)).alias("copies"), F.max("line").alias("line")).first()
        copies = df.sparkSession.range(end["copies"]).select(
            *[F.lit(last[c]).alias(c) for c in keys],
            F.concat(F.lit(end["line"]), F.when(F.col("id") < end["copies"] - 1, ",").otherwise("")).alias("line"),
            F.col("id").alias("_nth"))
        lines = lines.where((F.col("_part") != 1) | ~at_end).withColumns({
            "line": F.when(F.col("_part") == 1, F.concat("line", F.lit(","))).otherwise(F.col("line")),
            "_nth": F.lit(0).cast("long")}).unionByName(copies)
        keys = [*keys, "_nth"]
    lines = lines.orderBy(*keys).select("line")
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """CSV with header; nulls are empty cells."""
    _arranged(df, order, single).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_signatures(df: DataFrame, path: str, col: str = "signature", order: list[str] | None = None,
                     single: bool = False) -> None:
    """Signatures as text, a blank line after each."""
    _arranged(df, order, single).select(col).write.mode("overwrite").text(path, lineSep="\n\n")
