"""Queries that write a test table in a file format, read it back, and cases the other tables lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import chat as C
from alertloom.functions import text as X
from alertloom.operators import assertions as O
from alertloom.operators import evals as E
from alertloom.operators import feeds as W
from alertloom.operators import incidents as I
from alertloom.operators import prompts as P
from alertloom.operators import ranking as R
from alertloom.operators import sampling as S
from alertloom.operators import signatures as G
from alertloom.plans import inputs as N
from alertloom.plans import ranking, texts
from alertloom.plans.alerts import EVENTS_SQL
from alertloom.plans.ranking import RATES_SQL
from alertloom.plans.sampling import ORDERS_SQL
from alertloom.session import new_folder, shuffle_width
from alertloom.sinks import files as K
from alertloom.sources import alerts as A
from alertloom.sources import analyses as Y
from alertloom.sources import tables as B
from alertloom.streaming.feeds import stream_series


def repeated_incidents(spark, sf):
    """Two records under each incident id: one lists the events of even, one those of odd number."""
    record = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    links = N.event_base(spark, sf).select(
        record.alias("record"), "incident_id", (F.col("event_id") * 2).alias("pos"), F.col("event_id").cast("string").alias("event_id"))
    incidents = N.alert_incidents(spark, sf).select(
        F.explode(F.array(F.lit("even"), F.lit("odd"))).alias("record"), "*")
    linked = I.link_events(links, N.alert_events(spark, sf))
    report = I.incident_report(incidents, linked)
    groups = I.incident_groups(linked).groupBy("record", "incident_id").agg(F.count(F.lit(1)).alias("groups"))
    return report.join(groups, ["record", "incident_id"], "left").select(
        "record", "incident_id", "event_count", F.coalesce("groups", F.lit(0)).alias("groups"))


def judge_repeats(spark, sf):
    """Judge results that place one model twice and name one that nobody gave."""
    names = F.array(*[F.lit(m) for m in N.MODELS])
    one, two = (F.get(names, ((F.col("pos") + k) % 4).cast("int")) for k in (0, 1))
    results = N.order_incidents(spark, sf).select(
        "incident_id", F.map_from_arrays(F.array(*[F.lit(str(p)) for p in (1, 2, 3, 4)]), F.array(one, two, one, F.lit("unknown"))).alias("rankings"))
    return R.head_to_head(results, [*N.MODELS, "unknown"]).withColumn("win_percent", F.round("win_percent", 6))


def spoiled_lines(spark, sf):
    """Alert lines followed by words, by a second record, doubled by a comma, in single quotes or with a raw tab in
    a string; what is left counts."""
    k = F.col("k")
    line = F.format_string('{"Status": "Event", "ID": "%d", "Confidence": NaN}', "event_id")
    lines = N.event_base(spark, sf).select(
        F.when(k % 5 == 0, F.concat(line, F.lit(" and words"))).when(k % 5 == 1, F.concat(line, line))
        .when(k % 5 == 2, F.concat_ws(", ", line, line)).when(k % 10 == 3, F.replace(line, F.lit('"'), F.lit("'")))
        .when(k % 10 == 8, F.replace(line, F.lit("Event"), F.lit("Ev\tent"))).otherwise(line).alias("line"),
        F.lit("f").alias("source_file"), F.col("event_id").alias("line_order"))
    alerts = A.parse_lines(lines)
    return alerts.events.select("event_id", F.lit("event").alias("kind")).unionByName(
        alerts.rejects.select(F.col("line_order").cast("string").alias("event_id"), F.col("reason").alias("kind")))


def reject_lines(spark, sf):
    """Event lines in files, some blank or spoiled; which lines of which file were rejected."""
    path = new_folder(spark)
    k = F.col("k")
    line = F.when(k % 6 == 0, "").when(k % 6 == 1, "{'Status': 'Event'}").when(k % 6 == 2, '{"Status": "Other"}').otherwise('{"Status": "Event", "ID": "x"}')
    rows = N.event_base(spark, sf).select("w", "event_id", line.alias("value")).repartition("w").sortWithinPartitions("w", "event_id")
    rows.select("w", "value").write.partitionBy("w").text(path)
    rejects = A.read_alerts(spark, path).rejects
    return rejects.select(F.regexp_extract("source_file", "/w=([0-9]+)/", 1).cast("long").alias("w"), "line_num", "reason")


def json_outputs(spark, sf):
    """Outputs with several documents, words after one, single quotes, raw control characters or hundreds of braces that
    nobody closes, against assertions on JSON."""
    k = F.col("k")
    first, second = F.format_string('{"n": %d}', "k"), F.lit('{"ok": {"deep": [1, "}"]}}')
    output = (F.when(k % 8 == 0, first).when(k % 8 == 1, F.concat(first, F.lit(" trailing words")))
              .when(k % 8 == 2, F.concat(F.lit("first "), first, F.lit(" then "), second)).when(k % 8 == 3, F.concat(F.lit("{broken "), first))
              .when(k % 8 == 4, F.lit("{'ok': 1}")).when(k % 8 == 5, F.lit('{"ok": "a\tb"}'))
              .when(k % 8 == 6, F.concat(F.repeat(F.lit('{"a": '), F.lit(500)), second)).otherwise(F.concat(F.repeat(F.lit("{"), F.lit(500)), F.lit('"'), first)))
    # A few bytes of an event become a long output: events are dealt before their outputs are made, as one split of the table holds millions.
    events = N.event_base(spark, sf).select("event_id", "k").repartition(shuffle_width(spark))
    outputs = events.select(
        F.lit("m").alias("provider"), F.lit("s").alias("suite"), F.lit("t").alias("test"), F.col("event_id").alias("run"), output.alias("output"))
    checks = [{"suite": "s", "test": "t", "type": "is-json"}, {"suite": "s", "test": "t", "type": "contains-json"},
              {"suite": "s", "test": "t", "type": "contains-json", "value": {"required": ["ok"]}}]
    return O.check_outputs(outputs, checks).select("run", "assertion", "passed")


def rubric_assertions(spark, sf):
    """A judge's verdict as an assertion; without a verdict it does not hold."""
    outputs = N.test_outputs(spark, sf).withColumn(
        "verdict", F.when(F.col("run") % 3 == 0, True).when(F.col("run") % 3 == 1, False))
    checks = [{"suite": "format", "test": "first", "type": "llm-rubric", "value": "is polite"}]
    return O.check_outputs(outputs, checks, "verdict").select("run", "type", "passed")


SIGNATURES = {
    "not-dns": "dst-port != 53, 5353", "ports": "src-port == 1010-1019, 1050", "late": "src-port >= 1090",
    "large": "payload-size > 8", "outside": "src-ip != 10.0.0.0/15", "slash": r"payload /[A-Z]+ [0-9]*[05]$/",
    "state": "tcp-state established", "other": "requires-signature late", "bytes": "header ip[16:4] == 1.2.3.4",
    "broken": "payload /(/",
}


def _conditions(spark, sf):
    flows = N.flows(spark, sf).withColumn(
        "tcp_state", F.when(F.col("src_port") % 4 == 0, F.array(F.lit("established"))).otherwise(F.array().cast("array<string>")))
    rows = spark.createDataFrame([(f"signature {n} {{\n {b}\n}}",) for n, b in SIGNATURES.items()], "text string")
    return flows, G.parse_signatures(rows, "text")


def signature_conditions(spark, sf):
    flows, signatures = _conditions(spark, sf)
    return G.match_signatures(flows, signatures).select("event_id", "signature")


def signature_rejects(spark, sf):
    """A signature for each event, most with a line that flows can't be tested for, counted by reason."""
    k = F.col("k") % 5
    line = (F.when(k == 0, F.concat(F.lit("dst-port == "), F.col("k").cast("string"))).when(k == 1, "requires-signature other")
            .when(k == 2, "header ip[16:4] == 1.2.3.4").when(k == 3, "payload /(/").otherwise("http-request /x/"))
    texts = N.event_base(spark, sf).select(F.concat(F.lit("signature s"), F.col("event_id").cast("string"), F.lit(" {\n "), line, F.lit("\n}")).alias("text"))
    rejects = G.signature_rejects(N.flows(spark, sf), G.parse_signatures(texts, "text"))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("signatures"))


def signature_index(spark, sf):
    """A signature for each user that the events name: its address, a range of ports, met by the index."""
    user = F.col("user_id")
    bodies = F.format_string("signature u%d {\n src-ip == 10.%d.0.%d\n src-port == %d-%d, 1099\n event \"%d\"\n}", user, user % 7, user % 250,
                             1000 + user % 50, 1010 + user % 50, user)
    texts = N.event_base(spark, sf).select(bodies.alias("text")).distinct()
    return G.match_signatures(N.flows(spark, sf), G.parse_signatures(texts, "text")).select("event_id", "signature", "message")


def signature_examples(spark, sf):
    """Instruction records of the valid replies."""
    replies = N.signature_replies(spark, sf).select(
        "reply", F.lit("Write one").alias("instruction"), F.col("event_id").cast("string").alias("input"))
    return G.training_example(G.validate_signatures(replies, "reply"))


def feed_file(spark, sf):
    """A feed written with its description first, read by its header, matched with the addresses."""
    path = new_folder(spark)
    pages = N.table(spark, sf, "pages")
    kind = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    rows = pages.select(F.concat_ws("\t", kind, F.concat(F.lit("//"), kind, F.lit("/[0-9]+/"))).alias("value")).distinct()
    header = spark.createDataFrame([("#fields\tdescription\tregex",)], "value string")
    header.union(rows).write.text(path)
    return W.match_feed(pages.select("page_id", "url"), B.read_feed(spark, path), "url").select("page_id", "description")


def csv_table(spark, sf):
    path = new_folder(spark)
    K.write_table(N.table(spark, sf, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")), path)
    return B.read_csv(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


def nested_json(spark, sf):
    path = new_folder(spark)
    orders = N.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("evalId"), F.struct(F.length("o_orderpriority").alias("testPassCount"), F.struct(
            F.col("o_orderstatus").alias("x")).alias("deep")).alias("metrics"))
    K.write_records(orders, path)
    flat = B.read_flat_json(spark, path, "evalId bigint, metrics struct<testPassCount:int,deep:struct<x:string>>", multiline=False)
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


def analysis_lines(spark, sf):
    """Records written as JSON lines and read as analyses of the first file."""
    path = new_folder(spark)
    orders = N.order_incidents(spark, sf)
    K.write_records(orders.select("incident_id", "category", "threat_level", "event_count", F.col("severity").alias("summary")), path)
    return Y.read_record_lines(spark, [path]).select("incident_id", "category", "threat_level", "event_count", "summary", "file_order")


def _order_documents(spark, sf, wrapped: bool):
    """The orders as JSON documents, one for each status, read back in one scan."""
    path = new_folder(spark)
    orders = N.order_incidents(spark, sf).select("status", F.lit(1).alias("part"), "incident_id", "event_count")
    edge = lambda part: orders.select("status").distinct().select("status", F.lit(part).alias("part"), F.lit("").alias("incident_id"), F.lit(None).alias("event_count"))
    begin, end = ('{"note": [{"x": 1}], "incidents": [', '{"incident_id": "last"}]}') if wrapped else ("[", '{"incident_id": "last"}]')
    record = F.to_json(F.struct("incident_id", "event_count", F.lit('a "}" [b').alias("summary")))
    value = F.when(F.col("part") == 0, F.lit(begin)).when(F.col("part") == 2, F.lit(end)).otherwise(F.concat(record, F.lit(",")))
    # A document is one file, so one task sorts it: keys alone, texts are made behind the sort.
    whole = orders.union(edge(0)).union(edge(2)).repartition("status").sortWithinPartitions("status", "part", "incident_id")
    whole.select("status", value.alias("value")).write.partitionBy("status").text(path)
    return [f"{path}/status={s}" for s in ("P", "O", "F")]


def analysis_document(spark, sf):
    """Arrays of records, one document for each order status."""
    return Y.read_analyses(spark, _order_documents(spark, sf, False), "array").records.select("incident_id", "event_count", "summary", "pos", "file_order")


def wrapped_documents(spark, sf):
    """Objects that wrap the records, beside another array; documents of the other shape are rejected."""
    good = Y.read_analyses(spark, _order_documents(spark, sf, True), "wrapped")
    bad = Y.read_analyses(spark, _order_documents(spark, sf, False), "wrapped")
    counts = good.records.groupBy("file_order").agg(F.count(F.lit(1)).alias("records"), F.max("pos").alias("last"), F.sum("event_count").alias("events"))
    return counts.join(bad.rejects.select("file_order", F.lit("rejected").alias("other")), "file_order")


def judge_file(spark, sf):
    path = new_folder(spark)
    K.write_records(N.judge_results(spark, sf), path)
    results = B.read_judge_results(spark, path, multiline=False)
    return R.long_results(results, "incident_id").groupBy("incident_id", "model").agg(
        F.max("position").alias("position"), F.max("score").alias("score"))


def series_file(spark, sf):
    """Readings in files of a folder, read as a table and as a stream; the stream's are counted."""
    path, out = new_folder(spark), new_folder(spark)
    readings = N.table(spark, sf, "events").select(F.col("event_id").cast("double").alias("x"), "value")
    K.write_table(readings, path)
    stream = stream_series(spark, path).writeStream.format("parquet").option("checkpointLocation", f"{out}/state") \
        .trigger(availableNow=True).start(f"{out}/rows")
    stream.awaitTermination()
    arrived = spark.read.parquet(f"{out}/rows").groupBy("x").agg(F.count(F.lit(1)).alias("streamed"))
    return B.read_series(spark, path).join(arrived, "x").select("x", F.round("y", 6).alias("y"), "streamed")


def found_incident(spark, sf):
    return I.find_incident(N.alert_incidents(spark, sf), "3-1").select("incident_id", "event_count", "category")


def pass_rate_without(spark, sf):
    runs = E.with_description(N.eval_runs(spark, sf), N.eval_meta(spark, sf))
    return E.pass_rate(runs, ["openai:chat:model-1", "openai:chat:model-2"])


def category_cells(spark, sf):
    """Cells of the models that occur, which nobody names beforehand."""
    cells = R.model_by_category(N.judge_results(spark, sf))
    return cells.withColumns({c: F.round(c, 6) for c in ("avg_position", "avg_score")})


def sample_per_file(spark, sf):
    return S.sample_incidents(N.order_incidents(spark, sf), per_file=3, category="malware", seed=5).select("incident_id")


def model_file_names(spark, sf):
    tag = F.concat_ws("/", "s_name", F.concat(F.col("s_nationkey").cast("string"), F.lit(":7b")))
    return N.table(spark, sf, "supplier").select(
        "s_suppkey", X.model_file_name(tag).alias("name"), X.model_file_name(tag, drop_size=True).alias("family"))


def reasoning_chats(spark, sf):
    chats = N.table(spark, sf, "benchmark").select("item_id", C.reasoning_chat(F.lit("Why?"), F.col("text")).alias("c"))
    return chats.select("item_id", F.array_size("c").alias("turns"), F.col("c")[1]["content"].alias("asked"), F.col("c")[2]["content"].alias("answered"))


def hand_written_rows(spark, sf):
    ranks = N.table(spark, sf, "supplier").select(F.col("s_name").alias("provider"), F.col("s_acctbal").alias("score"))
    return E.append_rows(ranks, [{"provider": "by hand", "score": 1.5}, {"provider": "no score"}])


def filled_cells(spark, sf):
    """Report cells that hold something."""
    return R.model_by_category(N.judge_results(spark, sf), [*N.MODELS, "never seen"]).where(R.filled_cell()).select("category", "model", "count")


def _one_file_each(spark, sf):
    """The benchmark texts as files, every fifth blank and every seventh of other items very long."""
    path = new_folder(spark)
    item = F.col("item_id")
    text = F.when(item % 5 == 0, F.lit("  ")).when(item % 7 == 0, F.repeat("text", F.lit(3000))).otherwise(F.col("text"))
    N.table(spark, sf, "benchmark").select(item.alias("name"), text.alias("value")).repartition("name").write.partitionBy("name").text(path)
    return f"{path}/*/*.txt"


def _named(df):
    return df.withColumn("item_id", F.regexp_extract("source_file", "name=([0-9]+)", 1).cast("bigint")).drop("source_file")


def signature_files(spark, sf):
    return _named(B.read_signature_files(spark, _one_file_each(spark, sf))).select("item_id", F.md5("text").alias("text_md5"))


def reference_documents(spark, sf):
    path = _one_file_each(spark, sf)
    read = _named(B.read_reference_documents(spark, path)).select("item_id", F.lit("read").alias("reason"), F.md5("text").alias("text_md5"))
    left_out = _named(B.document_rejects(spark, path)).select("item_id", "reason", F.lit("").alias("text_md5"))
    return read.unionByName(left_out)


def prompt_files(spark, sf):
    return _named(B.read_prompts(spark, _one_file_each(spark, sf))).select("item_id", F.md5("prompt").alias("prompt_md5"))


def variation_prompts(spark, sf):
    valid = N.signature_replies(spark, sf).select("event_id", F.col("reply").alias("signature"))
    return P.variation_prompts(valid, "semantic", 3).select("event_id", F.col("prompt").contains(F.col("signature")).alias("holds"),
                                                            F.col("prompt").contains("{{").alias("open"))


QUERIES = {f.__name__: f for f in (
    repeated_incidents, judge_repeats, spoiled_lines, reject_lines, json_outputs, rubric_assertions, signature_conditions, signature_rejects, signature_index,
    signature_examples, feed_file, csv_table, nested_json, analysis_lines, analysis_document, wrapped_documents, judge_file, series_file,
    found_incident, pass_rate_without, category_cells, sample_per_file, model_file_names, reasoning_chats, hand_written_rows,
    filled_cells, variation_prompts, signature_files, reference_documents, prompt_files,
)}

_FLOWS = f"""{EVENTS_SQL},
flow AS (SELECT event_id, k, user_id % 7 AS net, upper(event_type) || ' ' || k AS payload, k + 1000 AS src_port,
                CASE k % 3 WHEN 0 THEN 53 WHEN 1 THEN 80 ELSE 443 END AS dst_port FROM ev)"""

_FILES = """WITH f AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '  ' WHEN item_id % 7 = 0 THEN repeat(text, 3000) ELSE text END AS t FROM benchmark),
    b AS (SELECT *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS bare FROM f)"""

ORACLES = {
    "signature_files": f"{_FILES} SELECT item_id, md5(bare) AS text_md5 FROM b WHERE bare <> ''",
    "reference_documents": f"""{_FILES} SELECT item_id, CASE WHEN strlen(t) + 1 > 51200 THEN 'too large' WHEN bare = '' THEN 'blank' ELSE 'read' END AS reason,
        CASE WHEN strlen(t) + 1 > 51200 OR bare = '' THEN '' ELSE md5(bare) END AS text_md5 FROM b""",
    "prompt_files": f"{_FILES} SELECT item_id, md5(t || chr(10)) AS prompt_md5 FROM b",
    "repeated_incidents": f"""WITH {EVENTS_SQL},
        r AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS record FROM ranked),
        c AS (SELECT record, incident_id, count(*) AS n, count(DISTINCT (severity, target_summary)) AS g FROM r GROUP BY ALL),
        i AS (SELECT DISTINCT incident_id, unnest(['even', 'odd']) AS record FROM ranked)
        SELECT record, incident_id, coalesce(n, 0) AS event_count, coalesce(g, 0) AS groups
        FROM i LEFT JOIN c USING (record, incident_id)""",
    "judge_repeats": f"""WITH {ORDERS_SQL},
        m AS (SELECT unnest({[*N.MODELS, 'unknown']!r}) AS model),
        p AS (SELECT incident_id, model, CASE WHEN model = list_extract({list(N.MODELS)!r}, CAST(pos % 4 + 1 AS INT)) THEN 3
                     WHEN model = list_extract({list(N.MODELS)!r}, CAST((pos + 1) % 4 + 1 AS INT)) THEN 2
                     WHEN model = 'unknown' THEN 4 ELSE 5 END AS place FROM inc, m)
        SELECT a.model AS model, b.model AS rival, count(*) FILTER (a.place < b.place) AS wins, count(*) AS total,
               round(100.0 * count(*) FILTER (a.place < b.place) / count(*), 6) AS win_percent
        FROM p a JOIN p b ON a.incident_id = b.incident_id AND a.model <> b.model GROUP BY ALL""",
    "spoiled_lines": f"""WITH {EVENTS_SQL}
        SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN k % 5 < 4 THEN 'bad json' ELSE 'event' END AS kind FROM ev""",
    "reject_lines": f"""WITH {EVENTS_SQL},
        n AS (SELECT CAST(w AS BIGINT) AS w, k, row_number() OVER (PARTITION BY w ORDER BY event_id) AS line_num FROM ev)
        SELECT w, line_num, CASE WHEN k % 6 = 1 THEN 'bad json' ELSE 'unknown status' END AS reason FROM n WHERE k % 6 IN (1, 2)""",
    "json_outputs": f"""WITH {EVENTS_SQL}
        SELECT event_id AS run, 0 AS assertion, k % 8 = 0 AS passed FROM ev
        UNION ALL SELECT event_id, 1, k % 8 NOT IN (4, 5) FROM ev
        UNION ALL SELECT event_id, 2, k % 8 IN (2, 6) FROM ev""",
    "rubric_assertions": f"""WITH {EVENTS_SQL}
        SELECT event_id AS run, 'llm-rubric' AS type, event_id % 3 = 0 AS passed FROM ev WHERE w < 2""",
    "signature_conditions": f"""WITH {_FLOWS}
        SELECT event_id, 'not-dns' AS signature FROM flow WHERE dst_port NOT IN (53, 5353)
        UNION ALL SELECT event_id, 'ports' FROM flow WHERE src_port BETWEEN 1010 AND 1019 OR src_port = 1050
        UNION ALL SELECT event_id, 'late' FROM flow WHERE src_port >= 1090
        UNION ALL SELECT event_id, 'large' FROM flow WHERE length(payload) > 8
        UNION ALL SELECT event_id, 'outside' FROM flow WHERE net > 1
        UNION ALL SELECT event_id, 'slash' FROM flow WHERE k % 5 = 0
        UNION ALL SELECT event_id, 'state' FROM flow WHERE src_port % 4 = 0""",
    "signature_rejects": f"""WITH {EVENTS_SQL}
        SELECT CASE k % 5 WHEN 1 THEN 'unsupported line: requires-signature other' WHEN 2 THEN 'unsupported line: header ip[16:4] == 1.2.3.4'
               WHEN 3 THEN 'bad pattern /(/' ELSE 'no column for http-request' END AS reason, count(*) AS signatures FROM ev WHERE k % 5 > 0 GROUP BY 1""",
    "signature_index": f"""WITH {EVENTS_SQL},
        f AS (SELECT event_id, user_id % 7 AS net, user_id % 250 AS host, k + 1000 AS src_port FROM ev),
        u AS (SELECT DISTINCT user_id AS u FROM ev)
        SELECT event_id, 'u' || u AS signature, CAST(u AS VARCHAR) AS message FROM f JOIN u ON net = u % 7 AND host = u % 250
               AND (src_port BETWEEN 1000 + u % 50 AND 1010 + u % 50 OR src_port = 1099)""",
    "signature_examples": f"""WITH c AS ({texts.ORACLES["signature_clean"]}), v AS ({texts.ORACLES["signature_validate"]})
        SELECT 'Write one' AS instruction, CAST(event_id AS VARCHAR) AS input, cleaned AS output
        FROM c JOIN v USING (event_id) WHERE valid""",
    "feed_file": r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS kind FROM pages),
        f AS (SELECT DISTINCT kind FROM u)
        SELECT page_id, f.kind AS description FROM u JOIN f ON regexp_matches(url, '/' || f.kind || '/[0-9]+')""",
    "csv_table": """SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer""",
    "nested_json": """SELECT o_orderkey AS "evalId", CAST(length(o_orderpriority) AS INT) AS "metrics_testPassCount",
        o_orderstatus AS metrics_deep_x FROM orders""",
    "analysis_lines": f"""WITH {ORDERS_SQL} SELECT incident_id, category, threat_level, event_count, severity AS summary,
        0 AS file_order FROM inc""",
    "analysis_document": f"""WITH {ORDERS_SQL},
        o AS (SELECT status, incident_id, event_count, 'a "}}" [b' AS summary FROM inc UNION ALL SELECT DISTINCT status, 'last', NULL, NULL FROM inc)
        SELECT incident_id, event_count, summary, row_number() OVER (PARTITION BY status ORDER BY incident_id = 'last', incident_id) - 1 AS pos,
               CASE status WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS file_order FROM o""",
    "wrapped_documents": f"""WITH {ORDERS_SQL}
        SELECT CASE status WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS file_order, count(*) + 1 AS records, count(*) AS "last",
               CAST(sum(event_count) AS BIGINT) AS events, 'rejected' AS other FROM inc GROUP BY status""",
    "judge_file": ranking.ORACLES["judge_long"],
    "series_file": "SELECT CAST(event_id AS DOUBLE) AS x, round(value, 6) AS y, CAST(1 AS BIGINT) AS streamed FROM events",
    "found_incident": f"""WITH {EVENTS_SQL}
        SELECT DISTINCT incident_id, (b * 97 + w * 613) % 3000 AS event_count, CASE WHEN b % 3 > 0 THEN 'Malware' ELSE 'Normal' END AS category
        FROM ranked WHERE incident_id = '3-1'""",
    "pass_rate_without": f"""WITH {RATES_SQL} SELECT * FROM rates
        WHERE provider NOT IN ('openai:chat:model-1', 'openai:chat:model-2')""",
    "category_cells": ranking.ORACLES["model_by_category"],
    "sample_per_file": f"""WITH {ORDERS_SQL} SELECT incident_id FROM inc WHERE lower(category) = 'malware'
        QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY md5('5|' || incident_id), incident_id) <= 3""",
    "model_file_names": """SELECT s_suppkey, s_name || '_' || s_nationkey || ':7b' AS name, s_name || '_' || s_nationkey AS family FROM supplier""",
    "reasoning_chats": "SELECT item_id, 3 AS turns, 'Why?' AS asked, text AS answered FROM benchmark",
    "hand_written_rows": """SELECT s_name AS provider, s_acctbal AS score FROM supplier
        UNION ALL SELECT 'by hand', 1.5 UNION ALL SELECT 'no score', NULL""",
    "filled_cells": f"""WITH c AS ({ranking.ORACLES["model_by_category"]}) SELECT category, model, "count" FROM c WHERE "count" > 0""",
    "variation_prompts": f"""WITH {EVENTS_SQL} SELECT event_id, true AS holds, false AS "open" FROM ev""",
}
