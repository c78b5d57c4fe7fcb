"""Queries that assemble, merge and verify datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import datasets as D
from alertloom.plans import inputs as N
from alertloom.plans.sampling import ORDERS_SQL
from alertloom.session import stored
from alertloom.sources.analyses import analysis_type


def _payload_text(payload):
    return F.array_join(F.transform(F.array_sort(F.map_entries(payload)), lambda e: F.concat_ws(
        "=", e["key"], F.coalesce(e["value"], F.lit("")))), ",")


def _mapping(spark, sf):
    """A category for the orders of status F, against what the records say."""
    return D.category_mapping(N.order_incidents(spark, sf).where(F.col("status") == "F").select(
        "incident_id", F.concat(F.lit("mapped "), "category").alias("category"),
        F.col("pos").alias("line_order")))


def _correlated(spark, sf):
    records = N.analysis_records(spark, sf).withColumn("payload", D.payload())
    return D.correlate(records, _mapping(spark, sf))


def correlate_nway(spark, sf):
    entries = F.transform(F.array_sort(F.map_keys("analyses")), lambda kind: F.concat_ws(
        ":", kind, _payload_text(F.col("analyses")[kind])))
    return _correlated(spark, sf).select(
        "incident_id", "category", "source_ip", "timewindow", "timeline", "threat_level",
        "event_count", F.size("analyses").alias("producers"), F.array_join(entries, ";").alias("analyses"))


def correlate_wide(spark, sf):
    types = ["dag", "llm_small", "llm_large", "cause_risk_small"]
    table = D.wide(_correlated(spark, sf), types)
    kept = [c for c in table.columns if c.endswith("_analysis") or c.startswith("cause_risk")]
    return table.select("incident_id", *[_payload_text(F.col(c)).alias(c) for c in kept])


def category_lookup(spark, sf):
    return _mapping(spark, sf)


def merge_first_wins(spark, sf):
    inputs = D.stacked(N.merge_inputs(spark, sf))
    return D.merge_first(inputs).select(
        "incident_id", "category", "threat_level", "event_count", "source_file", "file_order")


def _output(spark, sf):
    """The merge of the first two datasets only, so the check has something to find."""
    return D.merge_first(D.stacked(N.merge_inputs(spark, sf)[:2]))


def merge_counts(spark, sf):
    return D.merge_counts(D.stacked(N.merge_inputs(spark, sf)), _output(spark, sf))


def merge_duplicates(spark, sf):
    return D.duplicate_ids(D.stacked(N.merge_inputs(spark, sf))).select(
        "incident_id", "source_file", "copies", "total")


def merge_completeness(spark, sf):
    return D.completeness(D.stacked(N.merge_inputs(spark, sf)), _output(spark, sf))


def required_fields(spark, sf):
    return D.integrity(N.analysis_records(spark, sf))


def field_types(spark, sf):
    """Records as JSON text: a number as text for status O, a broken number for P, and text after the record for F."""
    orders = N.order_incidents(spark, sf)
    level = F.when(F.col("status") == "O", F.lit('"high"')).otherwise(F.lit("1.5"))
    count = F.when(F.col("status") == "P", F.lit("2.5")).otherwise(F.lit("2"))
    end = F.when(F.col("status") == "F", F.lit("} and so on")).otherwise(F.lit("}"))
    raw = F.concat(F.lit('{"threat_level": '), level, F.lit(', "event_count": '), count, end)
    return D.integrity(orders.select("incident_id", raw.alias("raw")).withColumn("present", F.json_object_keys("raw")))


def sortedness(spark, sf):
    """Customer numbers as ids, in order of the order keys; ranges of 1,000 make both rounds work."""
    orders = N.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("id"))
    return D.inversions(orders, "pos", "id", width=1000)


def verify_merge(spark, sf):
    inputs = D.stacked(N.merge_inputs(spark, sf))
    return D.verify_merge(inputs, stored(D.sorted_merge(inputs)))


def verify_spoiled_merge(spark, sf):
    """The merge of two datasets of three, left in the order of its input."""
    return D.verify_merge(D.stacked(N.merge_inputs(spark, sf)), stored(_output(spark, sf)))


def merge_sorted(spark, sf):
    return D.sorted_merge(D.stacked(N.merge_inputs(spark, sf))).select("incident_id", "category", "source_file", "pos")


def analysis_types(spark, sf):
    """Types read off file names made from the orders."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    name = (
        F.when(status == "F", F.concat(F.lit("a/day"), key, F.lit(".cause_risk.gpt-4o:x"), key, F.lit(".json")))
        .when(status == "O", F.concat(F.lit("b/day"), key, F.lit(".llm.qwen2.5.1.5b.json")))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("c/day.llm.phi-4."), key, F.lit(".json")))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("c/day"), key, F.lit(".dag.json")))
        .otherwise(F.concat(F.lit("plain."), key, F.lit(".json")))
    )
    return N.table(spark, sf, "orders").select(
        "o_orderkey", analysis_type(name).alias("analysis_type"))


QUERIES = {f.__name__: f for f in (
    correlate_nway, correlate_wide, category_lookup, merge_first_wins, merge_counts, merge_duplicates,
    merge_completeness, required_fields, field_types, sortedness, verify_merge, verify_spoiled_merge, merge_sorted,
    analysis_types,
)}

RECORDS_SQL = f"""{ORDERS_SQL},
found AS (
  SELECT *, 0 AS file_order, 'dag' AS kind, 'analysis=report ' || incident_id AS body FROM inc WHERE priority <> '5-LOW'
  UNION ALL SELECT *, 1, 'llm_small', 'behavior_analysis=acts ' || incident_id || ',summary=short ' || incident_id
            FROM inc WHERE status <> 'P'
  UNION ALL SELECT *, 2, 'llm_large', 'summary=long ' || incident_id FROM inc WHERE priority <> '1-URGENT'
  UNION ALL SELECT *, 3, 'cause_risk_small', 'cause_analysis=cause ' || incident_id || ',risk_assessment=risk '
            || incident_id FROM inc
  UNION ALL SELECT *, 4, 'dag', 'analysis=again ' || incident_id FROM inc WHERE status = 'O'),
valid AS (
  SELECT * FROM found WHERE NOT (status = 'F' AND priority = '4-NOT SPECIFIED')),
latest AS (
  SELECT incident_id, kind, arg_max(body, file_order) AS body FROM valid GROUP BY ALL),
heads AS (
  SELECT incident_id, min(file_order) AS file_order, any_value(status) AS status, any_value(category) AS category,
         any_value(threat_level) AS threat_level, any_value(event_count) AS event_count
  FROM valid GROUP BY incident_id),
wide AS (
  SELECT incident_id, max(CASE kind WHEN 'dag' THEN body END) AS dag,
         max(CASE kind WHEN 'llm_small' THEN body END) AS small,
         max(CASE kind WHEN 'llm_large' THEN body END) AS large,
         max(CASE kind WHEN 'cause_risk_small' THEN body END) AS risk,
         count(*) AS producers, string_agg(kind || ':' || body, ';' ORDER BY kind) AS analyses
  FROM latest GROUP BY incident_id)
"""

MERGE_SQL = f"""{ORDERS_SQL},
stack AS (
  SELECT * EXCLUDE (source_file), 'in0.json' AS source_file, 0 AS file_order FROM inc WHERE status <> 'P'
  UNION ALL SELECT * EXCLUDE (source_file), 'in1.json', 1 FROM inc WHERE status <> 'F'
  UNION ALL SELECT * EXCLUDE (source_file), 'in2.json', 2 FROM inc WHERE priority <> '5-LOW'),
merged AS (SELECT * FROM stack WHERE file_order < 2
  QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY file_order) = 1)
"""

ORACLES = {
    "correlate_nway": f"""WITH {RECORDS_SQL}
        SELECT incident_id, CASE WHEN status = 'F' THEN 'mapped ' || category
                                 WHEN file_order = 1 THEN 'Unknown' ELSE category END AS category,
               '10.0.0.' || file_order AS source_ip, 'Unknown' AS timewindow, 'now' AS timeline,
               threat_level, event_count, CAST(producers AS INT) AS producers, analyses
        FROM heads JOIN wide USING (incident_id)""",
    "correlate_wide": f"""WITH {RECORDS_SQL}
        SELECT incident_id, dag AS dag_analysis, small AS llm_small_analysis, large AS llm_large_analysis,
               risk AS cause_risk_small FROM wide""",
    "category_lookup": f"""WITH {ORDERS_SQL}
        SELECT incident_id, 'mapped ' || category AS mapped_category FROM inc WHERE status = 'F'""",
    "merge_first_wins": f"""WITH {MERGE_SQL}
        SELECT incident_id, category, threat_level, event_count, source_file, file_order FROM stack
        QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY file_order) = 1""",
    "merge_counts": f"""WITH {MERGE_SQL}
        SELECT count(*) AS input_total, count(DISTINCT incident_id) AS unique_ids,
               (SELECT count(*) FROM merged) AS output_count,
               count(*) - count(DISTINCT incident_id) AS duplicates_removed FROM stack""",
    "merge_duplicates": f"""WITH {MERGE_SQL},
        d AS (SELECT incident_id, count(*) AS total FROM stack GROUP BY incident_id HAVING count(*) > 1
              ORDER BY incident_id LIMIT 10)
        SELECT incident_id, source_file, count(*) AS copies, any_value(total) AS total
        FROM stack JOIN d USING (incident_id) GROUP BY incident_id, source_file""",
    "merge_completeness": f"""WITH {MERGE_SQL}
        SELECT DISTINCT incident_id, 'missing' AS side FROM stack
        WHERE incident_id NOT IN (SELECT incident_id FROM merged)""",
    "required_fields": f"""WITH {RECORDS_SQL}
        SELECT count(*) + count(*) FILTER (file_order = 1) AS missing_fields,
               count(*) FILTER (status = 'F' AND priority = '4-NOT SPECIFIED') AS empty_ids,
               CAST(0 AS BIGINT) AS type_errors FROM found""",
    "sortedness": """
        SELECT count(*) AS inversions FROM (
          SELECT CAST(o_custkey AS VARCHAR) AS id, lag(CAST(o_custkey AS VARCHAR)) OVER (ORDER BY o_orderkey) AS before
          FROM orders) WHERE before > id""",
    "verify_merge": f"""WITH {MERGE_SQL},
        c AS (SELECT count(*) AS n, count(DISTINCT incident_id) AS u FROM stack)
        SELECT 'files' AS "check", true AS passed, '' AS detail
        UNION ALL SELECT 'counts', true, n || ' in, ' || u || ' ids, ' || u || ' out, ' || (n - u) || ' removed' FROM c
        UNION ALL SELECT 'no_repeats', true, '0 repeated'
        UNION ALL SELECT 'complete', true, '0 missing, 0 extra'
        UNION ALL SELECT 'integrity', true, '0 missing fields, 0 empty ids, 0 type errors'
        UNION ALL SELECT 'sorted', true, '0 out of order'
        UNION ALL SELECT 'overall', true, '0 failed'""",
    "verify_spoiled_merge": f"""WITH {MERGE_SQL},
        s AS (SELECT count(*) AS bad FROM (
                SELECT incident_id, lag(incident_id) OVER (ORDER BY pos) AS before FROM merged) WHERE before > incident_id),
        c AS (SELECT count(*) AS n, count(DISTINCT incident_id) AS u, (SELECT count(*) FROM merged) AS o FROM stack),
        r AS (
          SELECT 'files' AS "check", true AS passed, '' AS detail
          UNION ALL SELECT 'counts', o = u, n || ' in, ' || u || ' ids, ' || o || ' out, ' || (n - u) || ' removed' FROM c
          UNION ALL SELECT 'no_repeats', true, '0 repeated'
          UNION ALL SELECT 'complete', u = o, (u - o) || ' missing, 0 extra' FROM c
          UNION ALL SELECT 'integrity', true, '0 missing fields, 0 empty ids, 0 type errors'
          UNION ALL SELECT 'sorted', bad = 0, bad || ' out of order' FROM s)
        SELECT * FROM r
        UNION ALL SELECT 'overall', bool_and(passed), count(*) FILTER (NOT passed) || ' failed' FROM r""",
    "merge_sorted": f"""WITH {MERGE_SQL},
        o AS (SELECT * FROM stack QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY file_order) = 1)
        SELECT incident_id, category, source_file, row_number() OVER (ORDER BY incident_id) - 1 AS pos FROM o""",
    "field_types": f"""WITH {RECORDS_SQL}
        SELECT CAST(5 * count(*) AS BIGINT) AS missing_fields, CAST(0 AS BIGINT) AS empty_ids,
               CAST(count(*) FILTER (status = 'O') + count(*) FILTER (status = 'P')
                    + 2 * count(*) FILTER (status = 'F') AS BIGINT) AS type_errors FROM found WHERE file_order = 3""",
    "analysis_types": """SELECT o_orderkey, CASE
          WHEN o_orderstatus = 'F' THEN 'cause_risk_gpt_4o:x' || o_orderkey
          WHEN o_orderstatus = 'O' THEN 'llm_qwen2_5_1_5b'
          WHEN o_orderpriority = '1-URGENT' THEN 'llm_phi_4_' || o_orderkey
          WHEN o_orderpriority = '5-LOW' THEN 'dag'
          ELSE 'plain_' || o_orderkey END AS analysis_type FROM orders""",
}
