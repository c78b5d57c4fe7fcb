"""Queries over judge results and prompt-test runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions.alerts import win_band
from alertloom.functions.text import without_provider_prefix
from alertloom.operators import evals as E
from alertloom.operators import ranking as R
from alertloom.plans import inputs as N
from alertloom.plans.sampling import ORDERS_SQL


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def model_stats(spark, sf):
    return _rounded(R.model_stats(N.judge_results(spark, sf)), "avg_position", "avg_score", "win_rate")


def model_by_category(spark, sf):
    cells = R.model_by_category(N.judge_results(spark, sf), list(N.MODELS))
    return _rounded(cells, "avg_position", "avg_score")


def model_by_complexity(spark, sf):
    cells = R.model_by_complexity(N.judge_results(spark, sf), list(N.MODELS))
    return _rounded(cells, "avg_position", "avg_score")


def head_to_head(spark, sf):
    duels = R.head_to_head(N.judge_results(spark, sf), list(N.MODELS))
    return _rounded(duels.withColumn("band", win_band(F.col("win_percent"))), "win_percent")


def model_rank(spark, sf):
    return R.model_rank(R.model_stats(N.judge_results(spark, sf))).select("rank", "model")


def best_model(spark, sf):
    results = N.judge_results(spark, sf)
    return R.best_model(R.model_stats(results), R.model_by_category(results, list(N.MODELS)))


def judge_table(spark, sf):
    table = R.judge_table(N.judge_results(spark, sf), {m: m for m in N.MODELS})
    return table.drop("threat_level")


def judge_long(spark, sf):
    results = N.judge_results(spark, sf)
    return R.positions(results, "incident_id").join(
        R.scores(results, "incident_id"), ["incident_id", "model"])


def result_details(spark, sf):
    texts = N.order_incidents(spark, sf).where(F.col("status") != "F").select(
        "incident_id", F.concat(F.lit("report "), "incident_id").alias("report"))
    return R.result_details(N.judge_results(spark, sf), texts).select(
        "incident_id", "short_id", "winner", "winner_score", "positions", "report")


def chart_series(spark, sf):
    results = N.judge_results(spark, sf)
    series = R.chart_series(R.model_stats(results), R.model_by_category(results, list(N.MODELS)))
    return _rounded(series, "value")


def _rates(spark, sf):
    return E.pass_rate(E.with_description(N.eval_runs(spark, sf), N.eval_meta(spark, sf)))


def _matrix(spark, sf):
    matrix = E.pass_matrix(_rates(spark, sf), N.SUITES)
    return matrix.withColumn("provider", without_provider_prefix(F.col("provider")))


def pass_rate(spark, sf):
    return _rates(spark, sf)


def pass_rate_pivot(spark, sf):
    matrix = _matrix(spark, sf)
    return matrix.select("provider", *[
        F.col(f"`{s}`").alias(s.lower().replace("#", "_")) for s in N.SUITES])


def pass_rate_unpivot(spark, sf):
    return E.long_matrix(_matrix(spark, sf))


def best_per_test(spark, sf):
    return E.best_per_suite(E.long_matrix(_matrix(spark, sf)))


def best_fast_per_test(spark, sf):
    pairs = E.best_fast_per_suite(E.long_matrix(_matrix(spark, sf)), N.serving_bench(spark, sf))
    return _rounded(pairs, "score_gap")


def row_mean_rank(spark, sf):
    ranks = E.mean_rank(_matrix(spark, sf), N.SUITES, drop_last=True)
    return _rounded(E.rank_with_speed(ranks, N.serving_bench(spark, sf)), "score", "tokens_per_second")


QUERIES = {f.__name__: f for f in (
    model_stats, model_by_category, model_by_complexity, head_to_head, model_rank, best_model,
    judge_table, judge_long, result_details, chart_series, pass_rate, pass_rate_pivot,
    pass_rate_unpivot, best_per_test, best_fast_per_test, row_mean_rank,
)}

JUDGE_SQL = f"""{ORDERS_SQL},
j AS (
  SELECT incident_id, event_count, CASE WHEN custkey % 50 = 7 THEN 'Unknown' ELSE category END AS category,
         u.m AS model, CAST(1 + (pos * 7 + custkey * 5 + u.i * 3) % 10 AS DOUBLE) AS score, inc.status AS status
  FROM inc, (SELECT unnest({list(N.MODELS)!r}) AS m, unnest([0, 1, 2, 3]) AS i) u
  WHERE inc.status <> 'P' OR u.i < 3),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, model) AS position,
         CASE WHEN event_count < 500 THEN 'simple' WHEN event_count < 2000 THEN 'medium' ELSE 'complex' END AS complexity
  FROM j),
stats AS (
  SELECT model, count(*) FILTER (position = 1) AS position_1, count(*) FILTER (position = 2) AS position_2,
         count(*) FILTER (position = 3) AS position_3, count(*) FILTER (position = 4) AS position_4,
         avg(position) AS avg_position, avg(score) AS avg_score, count(*) FILTER (position = 1) AS wins,
         100.0 * count(*) FILTER (position = 1) / (SELECT count(*) FROM orders) AS win_rate
  FROM pos GROUP BY model),
cells AS (
  SELECT category, model, count(*) AS "count", avg(position) AS avg_position, avg(score) AS avg_score,
         count(*) FILTER (position = 1) AS wins
  FROM pos WHERE category IN ('Malware', 'Normal') GROUP BY ALL)
"""

RATES_SQL = f"""
rates AS (
  SELECT 'openai:chat:model-' || l_suppkey AS provider, p_brand AS suite,
         count(*) FILTER (l_quantity > 25) AS total_pass, count(*) FILTER (l_quantity <= 25) AS total_fail,
         round(100.0 * count(*) FILTER (l_quantity > 25) / count(*), 2) AS pass_rate
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL),
long AS (
  SELECT replace(provider, 'openai:chat:', '') AS provider, suite, pass_rate AS score FROM rates
  WHERE suite IN ({', '.join(f"'{s}'" for s in N.SUITES)})),
bench AS (
  SELECT 'model-' || s_suppkey AS model, floor(s_acctbal) / 700.0 AS tokens_per_second FROM supplier),
best AS (
  SELECT suite, provider AS best_model, score AS best_score FROM long
  QUALIFY row_number() OVER (PARTITION BY suite ORDER BY score DESC, provider) = 1)
"""

ORACLES = {
    "model_stats": f"""WITH {JUDGE_SQL}
        SELECT model, position_1, position_2, position_3, position_4, round(avg_position, 6) AS avg_position,
               round(avg_score, 6) AS avg_score, wins, round(win_rate, 6) AS win_rate FROM stats""",
    "model_by_category": f"""WITH {JUDGE_SQL}
        SELECT category, model, "count", round(avg_position, 6) AS avg_position,
               round(avg_score, 6) AS avg_score, wins FROM cells""",
    "model_by_complexity": f"""WITH {JUDGE_SQL}
        SELECT complexity, model, count(*) AS "count", round(avg(position), 6) AS avg_position,
               round(avg(score), 6) AS avg_score, count(*) FILTER (position = 1) AS wins FROM pos GROUP BY ALL""",
    "head_to_head": f"""WITH {JUDGE_SQL},
        grid AS (SELECT incident_id, m.m AS model FROM inc, (SELECT unnest({list(N.MODELS)!r}) AS m) m),
        placed AS (SELECT g.incident_id, g.model, coalesce(position, 5) AS position
                   FROM grid g LEFT JOIN pos p ON g.incident_id = p.incident_id AND g.model = p.model),
        duels AS (
          SELECT a.model AS model, b.model AS rival, count(*) FILTER (a.position < b.position) AS wins,
                 count(*) AS total, 100.0 * count(*) FILTER (a.position < b.position) / count(*) AS p
          FROM placed a JOIN placed b ON a.incident_id = b.incident_id AND a.model <> b.model GROUP BY ALL)
        SELECT model, rival, wins, total, round(p, 6) AS win_percent,
               CASE WHEN p >= 60 THEN 'high' WHEN p >= 40 THEN 'medium' ELSE 'low' END AS band FROM duels""",
    "model_rank": f"""WITH {JUDGE_SQL}
        SELECT CAST(row_number() OVER (ORDER BY avg_position, model) AS INT) AS rank, model FROM stats""",
    "best_model": f"""WITH {JUDGE_SQL}
        SELECT 'overall' AS scope, model FROM (SELECT model FROM stats ORDER BY avg_position, model LIMIT 1)
        UNION ALL SELECT category, model FROM cells
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY avg_position, model) = 1""",
    "judge_table": f"""WITH {JUDGE_SQL}
        SELECT incident_id, any_value(category) AS category, any_value(event_count) AS event_count,
               {', '.join(f"max(CASE position WHEN {p} THEN model END) AS rank_{p}" for p in (1, 2, 3, 4))},
               {', '.join(f"max(CASE model WHEN '{m}' THEN score END) AS {m}_score" for m in N.MODELS)},
               {', '.join(f"CAST(max(CASE model WHEN '{m}' THEN position END) AS INT) AS {m}_position" for m in N.MODELS)}
        FROM pos GROUP BY incident_id""",
    "judge_long": f"WITH {JUDGE_SQL} SELECT incident_id, model, CAST(position AS INT) AS position, score FROM pos",
    "result_details": f"""WITH {JUDGE_SQL}
        SELECT incident_id, substr(incident_id, 1, 8) AS short_id, max(CASE position WHEN 1 THEN model END) AS winner,
               max(CASE position WHEN 1 THEN score END) AS winner_score,
               string_agg(position || ':' || substr(model, 1, 4), ' → ' ORDER BY position) AS positions,
               CASE WHEN any_value(status) = 'F' THEN 'N/A' ELSE 'report ' || incident_id END AS report
        FROM pos GROUP BY incident_id""",
    "chart_series": f"""WITH {JUDGE_SQL}
        SELECT 'wins' AS chart, 'win_rate' AS series, model, round(win_rate, 6) AS value FROM stats
        UNION ALL SELECT 'places', 'position_' || position, model, CAST(count(*) AS DOUBLE) FROM pos GROUP BY ALL
        UNION ALL SELECT 'places', 'position_4', model, 0.0 FROM stats WHERE position_4 = 0
        UNION ALL SELECT 'category', category || '_count', model, CAST("count" AS DOUBLE) FROM cells
        UNION ALL SELECT 'category', category || '_wins', model, CAST(wins AS DOUBLE) FROM cells""",
    "pass_rate": f"WITH {RATES_SQL} SELECT * FROM rates",
    "pass_rate_pivot": f"""WITH {RATES_SQL}
        SELECT replace(provider, 'openai:chat:', '') AS provider, {', '.join(
            f"max(CASE suite WHEN '{s}' THEN pass_rate END) AS {s.lower().replace('#', '_')}" for s in N.SUITES)}
        FROM rates GROUP BY 1""",
    "pass_rate_unpivot": f"WITH {RATES_SQL} SELECT * FROM long",
    "best_per_test": f"WITH {RATES_SQL} SELECT * FROM best",
    "best_fast_per_test": f"""WITH {RATES_SQL},
        fast AS (SELECT DISTINCT model FROM bench JOIN best ON model = best_model WHERE tokens_per_second > 8),
        quick AS (SELECT suite, provider AS fast_model, score AS fast_score FROM long
                  WHERE provider IN (SELECT model FROM fast)
                  QUALIFY row_number() OVER (PARTITION BY suite ORDER BY score DESC, provider) = 1)
        SELECT suite, best_model, best_score, fast_model, fast_score,
               round(abs(best_score - fast_score), 6) AS score_gap FROM best LEFT JOIN quick USING (suite)""",
    "row_mean_rank": f"""WITH {RATES_SQL},
        sums AS (SELECT provider, CASE WHEN count(*) = 24 THEN sum(score) / 24 END AS score
                 FROM (SELECT DISTINCT provider FROM long) LEFT JOIN
                      (SELECT * FROM long WHERE suite <> 'Brand#25') USING (provider) GROUP BY provider)
        SELECT provider, round(score, 6) AS score, 'Q4' AS quantization,
               round(tokens_per_second, 6) AS tokens_per_second
        FROM sums LEFT JOIN bench ON provider = model""",
}
