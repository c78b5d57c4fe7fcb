"""Queries over what the readers, writers and streams work on: paths, lines, documents, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import chat as C
from alertloom.operators import conversations as V
from alertloom.operators import evals as E
from alertloom.operators import sampling as S
from alertloom.plans import inputs as N
from alertloom.plans import ranking, texts
from alertloom.plans.ranking import RATES_SQL
from alertloom.plans.sampling import ORDERS_SQL
from alertloom.session import new_folder
from alertloom.sinks import files as K
from alertloom.sources import alerts as A
from alertloom.sources import tables as B
from alertloom.streaming.feeds import stream_match


def path_metadata(spark, sf):
    inc = N.order_incidents(spark, sf)
    root = F.when(F.col("priority") == "5-LOW", F.lit("elsewhere")).otherwise("datasets")
    path = F.concat_ws("/", F.lit("file:/x"), root, "category", "dataset", F.col("status"))
    paths = inc.select("incident_id", path.alias("source_file"))
    return A.path_metadata(paths, "datasets").drop("source_file")


def sample_lines(spark, sf):
    """The lines of a sample file: 200 orders with their line items."""
    inc = N.order_incidents(spark, sf)
    sample = S.sample_incidents(inc, n=200, seed=9).select(
        "source_file", "incident_id", "category",
        F.format_string('{"Status": "Incident", "ID": "%s"}', "incident_id").alias("raw_json"))
    items = N.table(spark, sf, "lineitem").select(
        F.concat(F.lit("inc-"), F.col("l_orderkey").cast("string")).alias("incident_id"),
        F.col("l_linenumber").alias("pos"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"),
        F.struct("l_partkey", "l_suppkey").alias("line_order"))
    placed = items.join(inc.select("incident_id", "source_file"), "incident_id")
    events = A.last_events(placed.select(
        "source_file", "event_id", "line_order", F.format_string('{"ID": "%s"}', "event_id").alias("raw_json")), "file")
    links = placed.select("source_file", "incident_id", "pos", "event_id")
    return K.sample_rows(sample, links, events)


def _chat_documents(spark, sf):
    """One JSON document per turn, in the three layouts a chat file may have."""
    text, role = F.col("text"), F.col("role")
    turn = F.struct(role.alias("role"), text.alias("content"))
    document = (
        F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.array(F.struct(F.array(turn).alias("conversation"))).alias("data"))))
        .when(F.col("turn") % 3 == 1, F.to_json(F.array(F.struct(text.alias("instruction"), role.alias("output")))))
        .otherwise(F.to_json(F.array(F.struct(F.array(turn, turn).alias("messages")), F.struct(F.array().cast(
            "array<struct<role:string,content:string>>").alias("messages")))))
    )
    return B.unwrap_chats(N.table(spark, sf, "conversations").select(document.alias("value")))


def chat_file_stats(spark, sf):
    return V.conversation_stats(_chat_documents(spark, sf)).withColumn("avg_turns", F.round("avg_turns", 6))


def chat_file_roles(spark, sf):
    return V.role_distribution(_chat_documents(spark, sf))


def shared_chats(spark, sf):
    """Turns as ``from`` and ``value``; system turns lack their speaker and are skipped."""
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt")
    turns = F.array(F.struct(speaker.alias("from"), F.col("text").alias("value")))
    chats = N.table(spark, sf, "conversations").select(
        "conv_id", "turn", C.sharegpt_chat(turns).alias("conversation"))
    return chats.where(F.size("conversation") > 0).select("conv_id", "turn", F.inline("conversation"))


def uri_feed_stream(spark, sf):
    """The pages as a stream of requests, matched with the feed and read back from the sink."""
    out = new_folder(spark)
    pages = N.table(spark, sf, "pages")
    # A stream takes a plain path for a folder; a pattern leads to the table's file as well as to its folder of files.
    requests = spark.readStream.schema(pages.schema).parquet(f"{sf}/pages.parque[t]").select("page_id", "url")
    query = stream_match(requests, lambda: texts._feed(spark, texts.FEED), f"{out}/result", f"{out}/state",
                         "url", available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result/matches").select("page_id", "url", "regex", "description")


def best_speed(spark, sf):
    best = E.best_per_suite(E.long_matrix(ranking._matrix(spark, sf)))
    return E.speed_of_best(best, N.serving_bench(spark, sf)).select(
        "suite", "model", "best_score", F.round("tokens_per_second", 6).alias("tokens_per_second"))


def score_gap_rows(spark, sf):
    pairs = E.best_fast_per_suite(E.long_matrix(ranking._matrix(spark, sf)), N.serving_bench(spark, sf))
    return E.gap_rows(pairs).withColumn("score_gap", F.round("score_gap", 6))


QUERIES = {f.__name__: f for f in (
    path_metadata, sample_lines, chat_file_stats, chat_file_roles, shared_chats, uri_feed_stream,
    best_speed, score_gap_rows,
)}

ORACLES = {
    "path_metadata": f"""WITH {ORDERS_SQL}
        SELECT incident_id, CASE WHEN priority = '5-LOW' THEN 'unknown' ELSE category END AS path_category,
               CASE WHEN priority = '5-LOW' THEN 'unknown' ELSE dataset END AS path_dataset,
               CASE WHEN priority = '5-LOW' THEN 'unknown' ELSE status END AS path_capture,
               'unknown' AS path_timewindow FROM inc""",
    "sample_lines": f"""WITH {ORDERS_SQL},
        s AS (SELECT * FROM inc ORDER BY md5('9|' || incident_id) LIMIT 200)
        SELECT source_file, incident_id, CAST(-1 AS BIGINT) AS pos, '{{"Status": "Incident", "ID": "' || incident_id
               || '", "category": "' || category || '"}}' AS line FROM s
        UNION ALL
        SELECT source_file, incident_id, l_linenumber, '{{"ID": "' || l_orderkey || '-' || l_linenumber || '"}}'
        FROM s JOIN lineitem ON l_orderkey = s.pos""",
    "chat_file_stats": """WITH n AS (SELECT turn % 3 AS m, count(*) AS c FROM conversations GROUP BY 1),
        t AS (SELECT sum(CASE m WHEN 2 THEN 2 * c ELSE c END) AS chats,
                     sum(CASE m WHEN 0 THEN c ELSE 2 * c END) AS turns,
                     sum(CASE m WHEN 2 THEN c ELSE 0 END) AS empties FROM n)
        SELECT CAST(chats AS BIGINT) AS total_samples, CAST(turns AS BIGINT) AS total_turns,
               round(CAST(turns AS DOUBLE) / chats, 6) AS avg_turns, CAST(empties AS BIGINT) AS empty_conversations FROM t""",
    "chat_file_roles": """SELECT role, CAST(sum(n) AS BIGINT) AS turns FROM (
          SELECT role, CASE turn % 3 WHEN 0 THEN 1 ELSE 2 END AS n FROM conversations WHERE turn % 3 <> 1
          UNION ALL SELECT 'user', 1 FROM conversations WHERE turn % 3 = 1
          UNION ALL SELECT 'assistant', 1 FROM conversations WHERE turn % 3 = 1) GROUP BY role""",
    "shared_chats": """SELECT conv_id, turn, role, text AS content FROM conversations
        WHERE role IN ('user', 'assistant')""",
    "uri_feed_stream": texts.ORACLES["uri_feed_match"],
    "best_speed": f"""WITH {RATES_SQL}
        SELECT suite, model, best_score, round(tokens_per_second, 6) AS tokens_per_second
        FROM best JOIN bench ON best_model = model""",
    "score_gap_rows": f"""WITH {RATES_SQL},
        fast AS (SELECT DISTINCT model FROM bench JOIN best ON model = best_model WHERE tokens_per_second > 8),
        quick AS (SELECT suite, provider AS fast_model, score AS fast_score FROM long
                  WHERE provider IN (SELECT model FROM fast)
                  QUALIFY row_number() OVER (PARTITION BY suite ORDER BY score DESC, provider) = 1),
        p AS (SELECT *, round(abs(best_score - fast_score), 6) AS score_gap FROM best LEFT JOIN quick USING (suite))
        SELECT suite, score_gap, 'Best Overall' AS type, best_score AS score, best_model AS model FROM p
        UNION ALL SELECT suite, score_gap, 'Best >8 TPS', fast_score, fast_model FROM p""",
}
