"""Queries that run whole workflows, with stand-ins for the models."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from alertloom.operators import datasets as D
from alertloom.operators import incidents as I
from alertloom.operators import ranking as R
from alertloom.operators import stores as S
from alertloom.plans import flows as W
from alertloom.plans import inputs as N
from alertloom.plans.alerts import EVENTS_SQL, PATTERNS_SQL
from alertloom.plans.alerts import ORACLES as ALERTS
from alertloom.plans.datasets import ORACLES as DATASETS
from alertloom.plans.sampling import ORACLES as SAMPLING
from alertloom.session import new_folder, shuffle_width, stored


def _count_lines(prompt: str) -> str:
    """Answers with the number of evidence lines and refuses one user group."""
    if prompt.startswith("Incident 3-"):
        raise RuntimeError("busy")
    return f"AI: {sum(line[2:3] == ':' for line in prompt.splitlines())} lines"


def _by_label(prompt: str) -> str:
    """Ranks the labels as they stand."""
    labels = [line[4:] for line in prompt.splitlines() if line.startswith("### ")]
    return json.dumps({
        "rankings": {str(n): label for n, label in enumerate(labels, 1)},
        "scores": {label: 10 - n for n, label in enumerate(labels, 1)}, "justification": "in order"})


def model_analyses(spark, sf):
    linked = I.link_events(N.alert_links(spark, sf), N.alert_events(spark, sf))
    return W.model_analyses(N.alert_incidents(spark, sf), linked, _count_lines, "cause").select(
        "incident_id", "event_count", "cause")


def judged_models(spark, sf):
    texts = F.map_from_arrays(F.array(*[F.lit(m) for m in N.MODELS]), F.array(*[
        F.concat_ws(" ", F.lit(m), "incident_id") for m in N.MODELS]))
    dataset = N.alert_incidents(spark, sf).withColumns({"analyses": texts, "report": F.lit("none")})
    results = W.judged_results(dataset, {m: m for m in N.MODELS}, _by_label, target=90)
    stats = R.model_stats(results)
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_position", "avg_score", "win_rate")})


def _answer(prompt: str) -> str:
    if "Medium" in prompt:
        raise ValueError("no answer")
    return f"{len(prompt)} characters"


def resumed_model(spark, sf):
    """Prompts of the events asked with a store: half of them in a first run, then all."""
    store = new_folder(spark)
    asked = N.alert_events(spark, sf).select("event_id", F.concat_ws(" ", "severity", "description").alias("prompt"))
    S.ask_once(asked.where(F.crc32(F.col("event_id").cast("binary")) % 2 == 0), "prompt", _answer, store, slices=2)
    return S.ask_once(asked, "prompt", _answer, store, slices=2).select("event_id", "reply", F.coalesce("error", F.lit("")).alias("error"))


def stored_merge(spark, sf):
    """The analysis records added to a bucketed store file by file, then correlated."""
    store = S.MergeStore(spark, new_folder(spark), shuffle_width(spark))
    rows = N.analysis_records(spark, sf).withColumn("payload", D.payload())
    for parity in (1, 0):
        store.add(rows.where(F.col("file_order") % 2 == parity))
    found = stored(store.correlated())
    store.close()
    return found.select("incident_id", "source_ip", "timewindow", "timeline", "threat_level", "event_count", F.size("analyses").alias("producers"))


def daily_source_summary(spark, sf):
    """Summaries of the days stored, and merged without the events."""
    path = new_folder(spark)
    S.write_days(S.daily_summary(N.alert_events(spark, sf)), path)
    found = S.summary_of_days(spark.read.parquet(path))
    return found.select("source_ip", "events", "severities", F.round("hours", 6).alias("hours"))


QUERIES = {f.__name__: f for f in (model_analyses, judged_models, resumed_model, stored_merge, daily_source_summary)}

ORACLES = {
    "model_analyses": f"""WITH {EVENTS_SQL}, {PATTERNS_SQL},
        c AS (SELECT incident_id, any_value(b) AS b, count(*) AS event_count FROM alert GROUP BY incident_id),
        n AS (SELECT incident_id, count(*) AS patterns FROM pgroups GROUP BY incident_id)
        SELECT incident_id, event_count,
               CASE WHEN b = 3 THEN 'Cause analysis failed: busy' ELSE patterns || ' lines' END AS cause
        FROM c JOIN n USING (incident_id)""",
    "judged_models": f"""WITH s AS ({SAMPLING["sample_stratified"]}),
        p AS (SELECT incident_id, u.m AS model, row_number() OVER (
                PARTITION BY incident_id ORDER BY md5('0|' || incident_id || '|' || u.m)) AS position
              FROM s, (SELECT unnest({list(N.MODELS)!r}) AS m) u)
        SELECT model, count(*) FILTER (position = 1) AS position_1, count(*) FILTER (position = 2) AS position_2,
               count(*) FILTER (position = 3) AS position_3, count(*) FILTER (position = 4) AS position_4,
               round(avg(position), 6) AS avg_position, round(avg(10.0::DOUBLE - position), 6) AS avg_score,
               count(*) FILTER (position = 1) AS wins,
               round(100.0 * count(*) FILTER (position = 1) / (SELECT count(*) FROM s), 6) AS win_rate
        FROM p GROUP BY model""",
    "resumed_model": f"""WITH {EVENTS_SQL}
        SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN severity = 'Medium' THEN 'query failed: no answer'
               ELSE length(severity || ' ' || description) || ' characters' END AS reply,
               CASE WHEN severity = 'Medium' THEN 'no answer' ELSE '' END AS error FROM alert""",
    "stored_merge": f"""SELECT incident_id, source_ip, timewindow, timeline, threat_level, event_count, producers
        FROM ({DATASETS["correlate_nway"]})""",
    "daily_source_summary": f"""SELECT source_ip, events, severities, hours FROM ({ALERTS["source_summary"]})""",
}
