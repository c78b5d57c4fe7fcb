"""The smaller inputs: CSV tables, nested JSON, feeds, series, signatures, prompts, chats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions.text import strip
from alertloom.schemas import JUDGE_RESULT, TURNS
from alertloom.session import stored

# Fixed value: the largest reference document that goes into a prompt, in bytes.
LARGEST_DOCUMENT = 50 * 1024


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns named by their path (``metrics.testPassCount``)."""
    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, here)
            else:
                quoted = ".".join(f"`{p}`" for p in here)
                out.append(F.col(quoted).alias(separator.join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def read_flat_json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    return flatten(spark.read.json(path, schema=schema, multiLine=multiline))


def read_judge_results(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return spark.read.json(path, schema=JUDGE_RESULT, multiLine=multiline)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Pattern feed: tab-separated ``/pattern/`` and description, in the order that the file's ``#fields`` line
    names them; without such a line the pattern comes first."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = lines.where(F.col("value").startswith("#fields")).first()
    names = re.split(r"[\t ]+", header[0].strip())[1:] if header else ["regex", "description"]
    if "regex" not in names:
        raise ValueError(f"no field regex among {names}")
    cells = F.split("value", "\t")

    def cell(name: str) -> Column:
        return F.get(cells, F.lit(names.index(name))) if name in names else F.lit(None).cast("string")

    return lines.where(~F.col("value").startswith("#")).select(
        F.regexp_replace(cell("regex"), "^/|/$", "").alias("regex"),
        F.coalesce(cell("description"), F.lit("")).alias("description"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_series(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Measured series: the first two columns by position, named after their file, whatever each file calls them.

    Each file's first line is its header, which says how wide the file is: a header of less than two columns is an error that names the file.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"), F.min("row").alias("row"))
    first = stored(first)
    narrow = first.where(F.size(F.split("header", ",")) < 2).select("file").limit(3).collect()
    if narrow:
        raise ValueError(f"a series file needs at least two columns: {', '.join(r.file for r in narrow)}")
    cells = F.from_csv("value", "x string, y string", {"mode": "PERMISSIVE"})
    body = lines.join(first.select("file", F.col("row").alias("head")), "file").where("row <> head AND value <> ''")
    name = F.substring_index("file", "/", -1)
    return body.select(name.alias("series"), cells.alias("c")).select(
        "series", F.col("c.x").try_cast("double").alias("x"), F.col("c.y").try_cast("double").alias("y"))


def unwrap_chats(documents: DataFrame, column: str = "value") -> DataFrame:
    """Chats out of JSON documents: ``{"data": [..]}`` or a bare array; each item holds
    ``conversation``, ``messages`` or ``instruction`` with ``output``, else an empty chat."""
    item = (
        f"struct<conversation:{TURNS},messages:{TURNS},instruction:string,output:string>"
    )
    value = F.col(column)
    bare = F.from_json(value, f"array<{item}>")
    wrapped = F.from_json(value, f"struct<data:array<{item}>>")["data"]
    items = F.when(F.regexp_replace(value, r"^\s+", "").startswith("["), bare).otherwise(wrapped)

    def turns(i: Column) -> Column:
        made = F.array(
            F.struct(F.lit("user").alias("role"), i["instruction"].alias("content")),
            F.struct(F.lit("assistant").alias("role"), i["output"].alias("content")),
        )
        built = F.when(i["instruction"].isNotNull() & i["output"].isNotNull(), made) \
            .otherwise(F.array().cast(TURNS))
        return F.coalesce(i["conversation"], i["messages"], built)

    return documents.select(F.posexplode(F.transform(items, turns)).alias("pos", "conversation"))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return unwrap_chats(spark.read.text(path, wholetext=True))


def read_signature_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole signature texts; a file of blanks yields no row."""
    return (
        spark.read.text(paths, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source_file"), strip(F.col("value")).alias("text"))
        .where(F.col("text") != "")
    )


def read_reference_documents(spark: SparkSession, paths: str | list[str],
                             largest: int = LARGEST_DOCUMENT) -> DataFrame:
    """Texts for a prompt; too large, blank or non-UTF-8 files yield no row but one of
    ``document_rejects``."""
    return _documents(spark, paths, largest).where(F.col("reason").isNull()).select("source_file", "text")


def document_rejects(spark: SparkSession, paths: str | list[str], largest: int = LARGEST_DOCUMENT) -> DataFrame:
    """Files that ``read_reference_documents`` leaves out, and why."""
    return _documents(spark, paths, largest).where(F.col("reason").isNotNull()).select("source_file", "reason")


def _documents(spark: SparkSession, paths: str | list[str], largest: int) -> DataFrame:
    small = F.col("length") <= largest
    text = strip(F.try_validate_utf8(F.when(small, F.col("content")).cast("string")))
    reason = F.when(~small, "too large").when(F.col("text").isNull(), "not UTF-8").when(F.col("text") == "", "blank")
    return spark.read.format("binaryFile").load(paths).select(
        F.col("path").alias("source_file"), "length", text.alias("text")).withColumn("reason", reason)


def read_prompts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("prompt")
    )


def usage_counters(output: Column) -> dict[str, Column]:
    """Counters printed by a serving benchmark; a counter not printed is null."""
    def number(label: str) -> Column:
        return F.regexp_extract(output, label + r":\s+([0-9.]+)", 1).try_cast("double")

    return {
        "prompt_tokens": number("Prompt tokens").cast("bigint"),
        "completion_tokens": number("Completion tokens").cast("bigint"),
        "total_tokens": number("Total tokens").cast("bigint"),
        "seconds": number("Time taken"),
        "tokens_per_second": number("Tokens per second"),
    }
