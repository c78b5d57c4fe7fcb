"""Stores that grow between runs, against working everything out anew."""

import collections

import pytest
from pyspark.sql import functions as F

from alertloom.operators import datasets as D
from alertloom.operators import incidents as I
from alertloom.operators import stores as S
from alertloom.plans import inputs as N


def test_prompts_are_asked_once_over_killed_runs(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def model(prompt, folder=str(log)):
        import uuid
        if prompt == "bad":
            raise ValueError("no answer")
        open(f"{folder}/{uuid.uuid4().hex}", "w").write(prompt)
        return prompt.upper()

    df = spark.createDataFrame([(i, f"p{i % 20}") for i in range(100)] + [(100, None), (101, "bad")], "n int, prompt string")
    first = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "n int, prompt string")
    store = str(tmp_path / "store")
    assert S.ask_once(first, "prompt", model, store, slices=3).count() == 7
    # A run that dies while it writes leaves a folder without a success mark.
    left = tmp_path / "store" / "9-unfinished"
    left.mkdir()
    (left / "part-0.parquet").write_bytes(b"half")
    for _ in range(2):
        rows = S.ask_once(df, "prompt", model, store, slices=3).collect()
        assert {(r.n, r.reply) for r in rows if r.prompt not in (None, "bad")} == {(i, f"P{i % 20}") for i in range(100)}
        assert {(r.n, r.reply, r.error) for r in rows if r.n >= 100} == {(100, None, None), (101, "query failed: no answer", "no answer")}
    asked = collections.Counter(p.read_text() for p in log.iterdir())
    assert asked == {f"p{i}": 1 for i in range(20)}
    assert S.ask_once(df, "prompt", model, store, slices=1, on_error="drop").where("n = 101").count() == 0


def records(spark, order, n):
    rows = spark.range(n).select(
        F.concat(F.lit("i"), ((F.col("id") * 7 + order * 3) % 40).cast("string")).alias("incident_id"), F.lit(f"type{order % 2}").alias("analysis_type"),
        F.create_map(F.lit("analysis"), F.concat(F.lit(f"{order}-"), F.col("id").cast("string"))).alias("payload"),
        F.lit("Normal").alias("category"), F.lit("1.1.1.1").alias("source_ip"), F.lit(str(order)).alias("timewindow"), F.lit(None).cast("string").alias("timeline"),
        F.lit(1.5).alias("threat_level"), F.col("id").alias("event_count"), F.lit(order).alias("file_order"), F.col("id").alias("pos"))
    return rows.unionByName(rows.limit(1).withColumn("incident_id", F.lit("")))


def test_files_added_one_by_one_merge_like_all_at_once(spark, tmp_path):
    store = S.MergeStore(spark, str(tmp_path / "store"), buckets=4)
    frames = [records(spark, k, 25) for k in (2, 0, 3, 1)]
    for frame in frames[:3]:
        store.add(frame)
    store.close()
    again = S.MergeStore(spark, str(tmp_path / "store"), buckets=4)  # another session finds what is stored
    again.add(frames[3])
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    assert key(again.correlated().select("incident_id", "timewindow", "event_count", "analyses")) == key(
        D.correlate(whole).select("incident_id", "timewindow", "event_count", "analyses"))
    first = D.merge_first(whole)
    assert key(again.merged().select("incident_id", F.get_json_object("record", "$.event_count").alias("n"))) == key(
        first.select("incident_id", F.col("event_count").cast("string").alias("n")))
    for df in (again.merged(), again.correlated()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    again.close()


def test_days_merge_to_the_summary_of_all_events(spark, sf, tmp_path):
    events = N.alert_events(spark, sf)
    path = str(tmp_path / "days")
    days = S.daily_summary(events)
    S.write_days(days, path)
    S.write_days(days.where(F.dayofyear("day") % 2 == 0), path)  # days that come again replace themselves
    got = {r.source_ip: r for r in S.summary_of_days(spark.read.parquet(path)).collect()}
    for r in I.source_summary(events).collect():
        own = got[r.source_ip]
        assert (own.events, own.severities) == (r.events, r.severities) and own.hours == pytest.approx(r.hours)
        assert abs(own.unique_targets - r.unique_targets) <= max(1, 0.05 * r.unique_targets)


def test_the_error_of_the_sketch(spark, tmp_path):
    rows = spark.range(60_000).select(F.array(F.lit("s")).alias("source_ips"), F.array(F.concat(F.lit("t"), (F.col("id") % 40_000).cast("string"))).alias("target_ips"),
                                      F.lit("Low").alias("severity"), F.format_string("2024-01-%02dT10:00:00Z", F.col("id") % 30 + 1).alias("start_time"))
    found = S.summary_of_days(S.daily_summary(rows)).first()
    assert found.events == 60_000 and abs(found.unique_targets / 40_000 - 1) < 0.05
