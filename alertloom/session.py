"""Session settings and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("alertloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``, which all executors share.

    A session on a local master that names none (tests) gets a temporary one; on a cluster that
    would be another folder on every machine, so there it is an error.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="alertloom-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/alertloom-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Python workers get at most ``rows`` rows at a time in what runs inside, fewer if the session says so."""
    before = spark.conf.get(ARROW_ROWS)
    if rows is None or 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(ARROW_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def stored(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    For results that are read more than once and are much smaller than what they come from. Python workers
    get at most ``batch`` rows at a time: the JVM and the worker both hold whole batches outside the heap.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    with arrow_batches(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def package_on_workers(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it too, also when the driver was started
    in another folder. On a cluster that ships it, nothing changes."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
