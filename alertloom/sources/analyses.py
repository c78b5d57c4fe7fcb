"""Analysis files: one JSON document per file, either an array of records or an object that wraps
the array as ``incidents``; JSON lines are read by ``read_record_lines``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.schemas import ANALYSIS
from alertloom.session import stored
from alertloom.sources.documents import document_records

SHAPES = ("any", "wrapped", "array")


class Analyses(NamedTuple):
    records: DataFrame
    rejects: DataFrame


def _typed(raw: DataFrame) -> DataFrame:
    record = F.from_json("raw", ANALYSIS)
    return raw.withColumn("r", record).select(
        "file_order", "pos", "source_file", "r.*",
        F.json_object_keys("raw").alias("present"), "raw",
    )


def _file_orders(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file`` and its place ``file_order`` in the caller's list, which may name files, folders and patterns; a file named twice
    has two. Paths are resolved by the file system that Spark reads them from; the files themselves are listed by Spark."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = []
    for order, path in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(path)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            named.append((status.getPath().toUri().toString().rstrip("/"), order))
    there = [paths[k] for k in sorted({order for _, order in named})]
    named = spark.createDataFrame(named, "named string, file_order int")
    if not there:
        return spark.createDataFrame([], "file string, path string, file_order int")
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(there))).select(F.col("_metadata.file_path").alias("file"), "path")
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # File systems print a path with one slash or three behind the scheme.
    plain = F.regexp_replace("named", "^(file:)/+", "$1/")
    return files.select("file", "path", F.explode(F.transform(above, lambda p: F.regexp_replace(p, "^(file:)/+", "$1/"))).alias("named")).join(
        named.select(plain.alias("named"), "file_order"), "named").select("file", "path", "file_order").distinct()


def _distinct_files(orders: DataFrame) -> list[str]:
    """The files to read, each once; those of several folders and patterns may be the same."""
    return [r.path for r in orders.select("path").distinct().collect()]


def read_analyses(spark: SparkSession, paths: list[str], shape: str = "any") -> Analyses:
    """Records of the files in the caller's order, and the files whose shape was not accepted.

    All files are read in one scan, a large one by many tasks (``document_records``).
    """
    if shape not in SHAPES:
        raise ValueError(f"shape must be one of {SHAPES}")
    orders = stored(_file_orders(spark, paths))
    files = _distinct_files(orders)
    if not files:
        raise ValueError(f"none of the {len(paths)} paths leads to a file")
    records, seen = document_records(spark, files)
    accepted = {
        "any": F.col("found"),
        "wrapped": F.col("found") & (F.col("first") == "{"),
        "array": F.col("first") == "[",
    }[shape]
    accepted = orders.drop("path").join(seen.where("whole").where(accepted).select("file"), "file")
    # A row for each file; by shuffle all records of a document would meet, and be sorted, in one task.
    raw = records.join(F.broadcast(accepted), "file").select("file_order", "pos", F.col("file").alias("source_file"), "raw")
    rejects = orders.join(accepted.select("file", "file_order"), ["file", "file_order"], "left_anti").select("file_order", F.col("file").alias("source_file"))
    return Analyses(_typed(raw), rejects)


def unreadable_files(spark: SparkSession, paths: list[str], shape: str = "any") -> DataFrame:
    """``file_order`` and ``source_file`` of the files that hold no document of the shape, and the named paths that lead to no file."""
    rejects = read_analyses(spark, paths, shape).rejects
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for order, path in enumerate(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not (at.getFileSystem(conf).globStatus(at) or []):
            gone.append((order, path))
    return rejects.union(spark.createDataFrame(gone, "file_order int, source_file string"))


def read_record_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same records from JSON-lines files, in one scan; ``pos`` orders the records of a file."""
    orders = stored(_file_orders(spark, paths))
    lines = spark.read.text(_distinct_files(orders)).select(
        F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("raw"))
    return _typed(lines.where(F.trim("raw") != "").join(orders.drop("path").withColumnRenamed("file", "source_file"), "source_file"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


# File-name marks and the analysis type each stands for, tried in this order.
NAME_MARKS = (
    ((".dag.",), "dag"),
    ((".llm.gpt-4o-mini.", ".llm.gpt4o"), "llm_gpt4o_mini"),
    ((".llm.qwen2.5.1.5b.",), "llm_qwen2_5_1_5b"),
    ((".llm.qwen2.5.", ".llm.qwen2_5."), "llm_qwen2_5"),
    ((".llm.qwen.",), "llm_qwen"),
    ((".llm.llama",), "llm_llama"),
)


def analysis_type(path: Column) -> Column:
    """Producer of an analysis file, read off its name; the first mark that occurs decides."""
    name = file_name(path)

    def model_after(mark: str) -> Column:
        rest = F.get(F.split(name, F.lit(mark.replace(".", r"\."))), F.lit(1))
        return F.translate(F.replace(rest, F.lit(".json"), F.lit("")), ".-", "__")

    kind = F.when(name.contains(".cause_risk."),
                  F.concat(F.lit("cause_risk_"), model_after(".cause_risk.")))
    for marks, meaning in NAME_MARKS:
        for mark in marks:
            kind = kind.when(name.contains(mark), meaning)
    return kind.when(
        name.contains(".llm."), F.concat(F.lit("llm_"), model_after(".llm."))
    ).otherwise(F.translate(F.replace(name, F.lit(".json"), F.lit("")), ".", "_"))


def dataset_kind(columns: list[str]) -> str:
    """What a wide dataset is about, judged by its column names alone."""
    if any("cause_risk" in c for c in columns):
        return "risk"
    if any("llm_" in c and "_analysis" in c for c in columns):
        return "summarisation"
    return "unknown"
