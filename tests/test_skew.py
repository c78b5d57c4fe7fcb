"""Texts and joins with one key far heavier than the rest."""

import pytest
from pyspark.sql import functions as F

from alertloom.operators import incidents as I
from alertloom.operators.skew import numbered_lines, ordered_text


def test_one_text_for_each_key(spark):
    lines = spark.range(500).select(
        F.when(F.col("id") < 400, "big").otherwise("small").alias("k"), F.col("id").alias("o"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("line")).repartition(7)
    for partitions in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = {r["k"]: r for r in ordered_text(lines, ["k"], ["o"], "line").collect()}
        assert rows["big"]["text"].split("\n") == [f"line {i}" for i in range(400)] and rows["small"]["lines"] == 100
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_lines_are_numbered_over_ranges(spark):
    lines = spark.range(1000).select(
        F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("k"), (F.col("id") * 7).alias("pos")).repartition(6)
    rows = numbered_lines(lines, ["k"], "pos", width=100).collect()
    for key in "ab":
        own = sorted((r["pos"], r["number"]) for r in rows if r["k"] == key)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_building_a_query_runs_no_job(spark):
    """Only what is written once, the counted descriptions of reports, runs before the result is asked for."""
    links = spark.createDataFrame([("i", 0, "e")], "incident_id string, pos bigint, event_id string")
    events = spark.createDataFrame([("e", "High", "2024-01-01T10:00:00Z", "d", ["1.1.1.1"], [80])],
                                   "event_id string, severity string, start_time string, description string, "
                                   "target_ips array<string>, target_ports array<int>")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    linked = I.link_events(links, events)
    I.evidence_text(I.pattern_groups(linked)), I.raw_evidence_text(linked), I.size_reduction(I.pattern_groups(linked))
    I.missing_events(links, events), I.link_counts(links, events), I.incident_groups(linked)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_examples_are_cut_before_the_shuffle(spark):
    counts = spark.range(100).selectExpr(
        "cast(id % 2 AS string) AS incident_id", "cast(id % 3 AS string) AS severity",
        "cast(id % 5 AS string) AS target_summary", "id AS copies", "id AS first_pos")
    plan = I.group_examples(counts)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_texts_use_the_named_folder(spark):
    from alertloom.session import new_folder
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or new_folder(spark).startswith(named.rstrip("/"))


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from alertloom import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        session.new_folder(Session())
