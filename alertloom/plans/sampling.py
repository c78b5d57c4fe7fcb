"""Queries that draw samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import sampling as S
from alertloom.plans import inputs as N


def sample_global(spark, sf):
    return S.sample_incidents(N.order_incidents(spark, sf), n=50).select("incident_id", "category")


def sample_per_group(spark, sf):
    drawn = S.sample_incidents(N.order_incidents(spark, sf), per_file=5, severity="high")
    return drawn.select("source_file", "incident_id")


def sample_file_subset(spark, sf):
    drawn = S.sample_incidents(N.order_incidents(spark, sf), files=7, per_file=1500, category="malware",
                               seed=3)
    return drawn.select("source_file", "incident_id", "category")


def sample_half(spark, sf):
    """A share of the table, too large to be ordered in one place."""
    drawn = S.take_by_hash(N.order_incidents(spark, sf), "incident_id", fraction=0.5, seed=11)
    return drawn.select("incident_id", "event_count")


def sample_share_by_dataset(spark, sf):
    drawn = S.take_by_hash(N.order_incidents(spark, sf), "incident_id", fraction=0.1, by=["dataset"], seed=5)
    return drawn.select("dataset", "incident_id")


def sample_stratified(spark, sf):
    drawn = S.stratified_sample(N.alert_incidents(spark, sf), target=90)
    return drawn.select("incident_id", "category", "event_count", "sample_order")


def sample_stats(spark, sf):
    return S.sample_statistics(N.order_incidents(spark, sf)).withColumn("value", F.round("value", 6))


def eval_sample_stats(spark, sf):
    stats = S.evaluation_statistics(N.order_incidents(spark, sf))
    return stats.withColumns({c: F.round(c, 6) for c in ("share", "avg_event_count", "avg_threat_level")})


def ratio_mix(spark, sf):
    turns = N.table(spark, sf, "conversations").withColumn(
        "turn_id", F.col("conv_id") * 1000 + F.col("turn"))
    frames = [turns.where(F.col("role") == "user"), turns.where(~F.col("role").eqNullSafe("user"))]
    return S.mix(frames, [0.75, 0.25], "turn_id").select("turn_id", "role")


def label_shuffle(spark, sf):
    shown = S.label_shuffle(N.order_incidents(spark, sf), list(N.MODELS), ["A", "B", "C", "D"])
    return shown.select("incident_id", *[
        F.element_at("randomization", label).alias(f"label_{label.lower()}") for label in "ABCD"])


GRID = {"threat": ["botnet", "tunnel", "scan"], "protocol": ["HTTP", "DNS", "SSH", "SMTP"],
        "context": ["office", "cloud"]}


def prompt_grid(spark, sf):
    parts = N.table(spark, sf, "part").select("p_partkey")
    return S.prompt_grid(parts, GRID, "p_partkey", seed=1)


QUERIES = {f.__name__: f for f in (
    sample_global, sample_per_group, sample_file_subset, sample_half, sample_share_by_dataset,
    sample_stratified, sample_stats, eval_sample_stats, ratio_mix, label_shuffle, prompt_grid,
)}

ORDERS_SQL = """
inc AS (
  SELECT 'inc-' || o_orderkey AS incident_id, o_orderkey AS pos, o_custkey AS custkey,
         CASE WHEN o_custkey % 3 > 0 THEN 'Malware' ELSE 'Normal' END AS category,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'High'
              WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END AS severity,
         'set-' || (o_custkey % 5) AS dataset,
         'capture-' || (o_custkey % 40) || '/alerts.json' AS source_file,
         CAST(floor(o_totalprice / 100) AS BIGINT) AS event_count,
         floor(o_totalprice) / 10000.0 AS threat_level,
         o_orderstatus AS status, o_orderpriority AS priority
  FROM orders)
"""


def _grid_sql() -> str:
    columns = []
    for name, values in GRID.items():
        listed = ", ".join(f"'{v}'" for v in values)
        draw = f"CAST('0x' || substr(md5('1|{name}|' || p_partkey), 1, 8) AS BIGINT)"
        columns.append(f"([{listed}])[1 + {draw} % {len(values)}] AS {name}")
    return f"SELECT p_partkey, {', '.join(columns)} FROM part"


ORACLES = {
    "sample_global": f"""WITH {ORDERS_SQL} SELECT incident_id, category FROM inc
        ORDER BY md5('0|' || incident_id) LIMIT 50""",
    "sample_per_group": f"""WITH {ORDERS_SQL} SELECT source_file, incident_id FROM inc
        WHERE severity = 'High'
        QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY md5('0|' || incident_id)) <= 5""",
    "sample_file_subset": f"""WITH {ORDERS_SQL},
        f AS (SELECT source_file FROM (SELECT DISTINCT source_file FROM inc WHERE category = 'Malware')
              ORDER BY md5('3|' || source_file) LIMIT 7)
        SELECT source_file, incident_id, category FROM inc
        WHERE category = 'Malware' AND source_file IN (SELECT source_file FROM f)
        QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY md5('3|' || incident_id)) <= 1500""",
    "sample_half": f"""WITH {ORDERS_SQL} SELECT incident_id, event_count FROM inc
        QUALIFY row_number() OVER (ORDER BY md5('11|' || incident_id))
                <= (SELECT floor(count(*) * 0.5) FROM orders)""",
    "sample_share_by_dataset": f"""WITH {ORDERS_SQL} SELECT dataset, incident_id FROM inc
        QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('5|' || incident_id))
                <= floor(count(*) OVER (PARTITION BY dataset) * CAST(0.1 AS DOUBLE))""",
    "sample_stratified": """WITH
        ev AS (SELECT *, user_id % 30 AS b, (day(ts) - 1) // 6 AS w FROM events),
        inc AS (
          SELECT DISTINCT b || '-' || w AS incident_id, b * 10 + w AS pos, (b * 97 + w * 613) % 3000 AS event_count,
                 CASE WHEN b % 3 > 0 THEN 'Malware' ELSE 'Normal' END AS category FROM ev),
        tiers AS (
          SELECT *, md5('42|' || incident_id) AS h,
                 CASE WHEN category = 'Normal' THEN 'kept' WHEN event_count < 500 THEN 'simple'
                      WHEN event_count < 2000 THEN 'medium' ELSE 'complex' END AS tier FROM inc),
        kept AS (SELECT * FROM tiers WHERE tier = 'kept' ORDER BY pos LIMIT 90),
        need AS (SELECT greatest(90 - count(*), 0) AS n FROM kept),
        ranked AS (
          SELECT t.*, n, row_number() OVER (PARTITION BY tier ORDER BY h) AS r,
                 n // 3 + CASE WHEN n % 3 > CASE tier WHEN 'simple' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END
                               THEN 1 ELSE 0 END AS quota
          FROM tiers t, need WHERE tier <> 'kept'),
        fill AS (
          SELECT *, row_number() OVER (ORDER BY h) AS s FROM ranked WHERE r > quota),
        picked AS (
          SELECT incident_id, category, event_count, h FROM kept
          UNION ALL SELECT incident_id, category, event_count, h FROM ranked WHERE r <= quota
          UNION ALL SELECT incident_id, category, event_count, h FROM fill
                    WHERE s <= n - (SELECT count(*) FROM ranked WHERE r <= quota))
        SELECT incident_id, category, event_count, CAST(row_number() OVER (ORDER BY h) AS INT) AS sample_order
        FROM picked""",
    "sample_stats": f"""WITH {ORDERS_SQL},
        n AS (SELECT *, event_count AS num_events, coalesce(severity, 'Unknown') AS sev FROM inc)
        SELECT 'total_incidents' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM n
        UNION ALL SELECT 'total_events', '', CAST(sum(num_events) AS DOUBLE) FROM n
        UNION ALL SELECT 'min_events', '', CAST(min(num_events) AS DOUBLE) FROM n
        UNION ALL SELECT 'max_events', '', CAST(max(num_events) AS DOUBLE) FROM n
        UNION ALL SELECT 'avg_events', '', round(avg(num_events), 6) FROM n
        UNION ALL SELECT 'by_category', category, CAST(count(*) AS DOUBLE) FROM n GROUP BY category
        UNION ALL SELECT 'by_severity', sev, CAST(count(*) AS DOUBLE) FROM n GROUP BY sev
        UNION ALL SELECT 'by_dataset', dataset, CAST(count(*) AS DOUBLE) FROM n GROUP BY dataset""",
    "eval_sample_stats": f"""WITH {ORDERS_SQL}
        SELECT category, count(*) AS incidents,
               round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS share,
               min(event_count) AS min_event_count, max(event_count) AS max_event_count,
               round(avg(event_count), 6) AS avg_event_count,
               min(threat_level) AS min_threat_level, max(threat_level) AS max_threat_level,
               round(avg(threat_level), 6) AS avg_threat_level
        FROM inc GROUP BY GROUPING SETS ((), (category))""",
    "ratio_mix": """WITH t AS (SELECT conv_id * 1000 + turn AS turn_id, role FROM conversations),
        r AS (SELECT *, row_number() OVER (PARTITION BY role IS NOT DISTINCT FROM 'user' ORDER BY md5('42|' || turn_id)) AS n,
                     count(*) OVER (PARTITION BY role IS NOT DISTINCT FROM 'user') AS total FROM t)
        SELECT turn_id, role FROM r
        WHERE n <= floor(total * CASE role WHEN 'user' THEN 0.75 ELSE 0.25 END)""",
    "label_shuffle": f"""WITH {ORDERS_SQL},
        m AS (SELECT incident_id, u.m AS model, row_number() OVER (
                PARTITION BY incident_id ORDER BY md5('0|' || incident_id || '|' || u.m)) AS n
              FROM inc, (SELECT unnest({list(N.MODELS)!r}) AS m) u)
        SELECT incident_id, max(CASE n WHEN 1 THEN model END) AS label_a,
               max(CASE n WHEN 2 THEN model END) AS label_b, max(CASE n WHEN 3 THEN model END) AS label_c,
               max(CASE n WHEN 4 THEN model END) AS label_d
        FROM m GROUP BY incident_id""",
    "prompt_grid": _grid_sql(),
}
