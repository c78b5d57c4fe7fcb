"""The test tables as alerts, incidents, analyses, judge results and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.once import evaluated_once

MODELS = ("alpha", "beta", "delta", "gamma")
SUITES = [f"Brand#{i}" for i in range(1, 26)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _case(value: Column, choices: dict, default=None) -> Column:
    out = F.lit(default)
    for key, result in choices.items():
        out = F.when(value == key, result).otherwise(out)
    return out


def event_base(spark: SparkSession, sf: str) -> DataFrame:
    """events with the number in props and the incident each belongs to: user group and six days."""
    group = F.col("user_id") % 30
    window = F.floor((F.dayofmonth("ts") - 1) / 6)
    return evaluated_once(table(spark, sf, "events"), {
        "b": group, "w": window, "k": F.get_json_object("props", "$.k").cast("int"),
        "incident_id": F.concat_ws("-", group.cast("string"), window.cast("string")),
    }).drop("props")


def iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def event_fields() -> dict[str, Column]:
    k = F.col("k")
    ip = F.concat(F.lit("192.168.0."), (k % 3).cast("string"))
    port = _case(k % 3, {0: 53, 1: 80}, 443)
    return {
        "severity": _case(F.col("event_type"), {"error": "High", "purchase": "Medium",
                                                "signup": "Low", "click": "Info"}, "Unknown"),
        "start_time": iso(F.col("ts")),
        "confidence": F.col("value") / 500,
        "source_ips": F.array(F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))),
        "target_ips": F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(ip)),
        "target_ports": F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.array(port)),
        "description": _case(k % 4, {
            0: F.format_string("Connection to %s:%d", ip, port),
            1: F.format_string("Detected a horizontal port scan to port %d/TCP. %d unique dst IPs", port, k),
            2: F.format_string("Connecting to private IP: %s on destination port: %d", ip, port),
        }, None),
    }


def alert_events(spark: SparkSession, sf: str) -> DataFrame:
    fields = event_fields()
    fields["description"] = F.coalesce(
        fields["description"], F.format_string("%d reconnection attempts", F.col("k")))
    base = event_base(spark, sf)
    return base.select(
        F.col("event_id").cast("string").alias("event_id"), *[c.alias(n) for n, c in fields.items()])


def alert_links(spark: SparkSession, sf: str) -> DataFrame:
    """One link per event, and for each event of value k = 0, 20, 40.. a second one to an event
    that does not exist."""
    base = event_base(spark, sf)
    own = F.struct((F.col("event_id") * 2).alias("pos"), F.col("event_id").cast("string").alias("event_id"))
    lost = F.struct((F.col("event_id") * 2 + 1).alias("pos"),
                    F.concat(F.lit("lost-"), F.col("event_id").cast("string")).alias("event_id"))
    listed = F.when(F.col("k") % 20 == 0, F.array(own, lost)).otherwise(F.array(own))
    return base.select("incident_id", F.inline(listed))


def alert_incidents(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return (
        event_base(spark, sf).groupBy("incident_id", "b", "w")
        .agg(cents.alias("cents"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        .select(
            "incident_id",
            F.array(F.concat(F.lit("10.0.0."), F.col("b").cast("string"))).alias("source_ips"),
            F.col("w").cast("string").alias("timewindow"),
            (F.floor(F.col("cents") / 100) / F.lit(100.0)).alias("threat_level"),
            iso(F.col("first")).alias("start_time"), iso(F.col("last")).alias("end_time"),
            F.when(F.col("b") % 3 > 0, "Malware").otherwise("Normal").alias("category"),
            ((F.col("b") * 97 + F.col("w") * 613) % 3000).alias("event_count"),
            (F.col("b") * 10 + F.col("w")).alias("pos"),
        )
    )


def alert_lines(spark: SparkSession, sf: str, spoiled: bool = False) -> DataFrame:
    """The events as JSON lines; if asked for, some of them broken in the ways files are."""
    fields = event_fields()
    description = F.coalesce(
        fields["description"], F.format_string("%d reconnection attempts", F.col("k")))
    base = event_base(spark, sf)
    line = F.to_json(F.struct(
        F.lit("Event").alias("Status"), F.col("event_id").cast("string").alias("ID"),
        fields["severity"].alias("Severity"), fields["start_time"].alias("StartTime"),
        fields["confidence"].alias("Confidence"), description.alias("Description"),
        F.array(F.struct(fields["source_ips"][0].alias("IP"))).alias("Source"),
        F.array(F.struct(F.get(fields["target_ips"], F.lit(0)).alias("IP"),
                         fields["target_ports"].alias("Port"))).alias("Target"),
        F.to_json(F.struct(F.col("w").alias("timewindow"), F.lit("x").alias("uids"))).alias("Note"),
    ))
    if spoiled:
        line = (
            F.when(F.col("k") % 17 == 0, F.lit("{bad"))
            .when(F.col("k") % 19 == 0, F.lit("[1]"))
            .when(F.col("k") % 23 == 0, F.replace(line, F.lit('"Event"'), F.lit('"Test"')))
            .otherwise(line)
        )
    return base.select(
        line.alias("line"), F.concat(F.lit("f"), (F.col("b") % 8).cast("string")).alias("source_file"),
        F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
                 F.col("event_id").alias("row")).alias("line_order"),
    )


# ---- datasets over orders ---------------------------------------------------------------------

def order_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """One incident per order; the price gives event count and threat level."""
    file_no = (F.col("o_custkey") % 40).cast("string")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"),
        F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_custkey") % 3 > 0, "Malware").otherwise("Normal").alias("category"),
        _case(F.col("o_orderpriority"), {"1-URGENT": "High", "2-HIGH": "High", "3-MEDIUM": "Medium",
                                         "5-LOW": "Low"}).alias("severity"),
        F.concat(F.lit("set-"), (F.col("o_custkey") % 5).cast("string")).alias("dataset"),
        F.concat(F.lit("capture-"), file_no, F.lit("/alerts.json")).alias("source_file"),
        F.floor(F.col("o_totalprice") / 100).cast("bigint").alias("event_count"),
        (F.floor("o_totalprice") / F.lit(10000.0)).alias("threat_level"),
        F.floor(F.col("o_totalprice") / 100).cast("bigint").alias("num_events"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").alias("custkey"),
    )


_RECORD = (
    "struct<file_order:int,analysis_type:string,analysis:string,summary:string,"
    "behavior_analysis:string,cause_analysis:string,risk_assessment:string>"
)


def analysis_records(spark: SparkSession, sf: str) -> DataFrame:
    """What five files say about the orders. Each leaves some out: the first those of low
    priority, the second those of status P, the third urgent ones; the fifth repeats the producer
    of the first for status O. Records of status F with priority 4 have lost their id."""
    def record(order: int, kind: str, **texts: Column) -> Column:
        names = ("analysis", "summary", "behavior_analysis", "cause_analysis", "risk_assessment")
        return F.struct(
            F.lit(order).alias("file_order"), F.lit(kind).alias("analysis_type"),
            *[texts.get(n, F.lit(None).cast("string")).alias(n) for n in names])

    def text(word: str) -> Column:
        return F.concat(F.lit(word + " "), F.col("incident_id"))

    status, priority = F.col("status"), F.col("priority")
    found = F.array_compact(F.array(
        F.when(priority != "5-LOW", record(0, "dag", analysis=text("report"))),
        F.when(status != "P", record(1, "llm_small", summary=text("short"),
                                     behavior_analysis=text("acts"))),
        F.when(priority != "1-URGENT", record(2, "llm_large", summary=text("long"))),
        record(3, "cause_risk_small", cause_analysis=text("cause"), risk_assessment=text("risk")),
        F.when(status == "O", record(4, "dag", analysis=text("again"))),
    ))
    lost = (status == "F") & (priority == "4-NOT SPECIFIED")
    rows = order_incidents(spark, sf).select("*", F.inline(found.cast(f"array<{_RECORD}>")))
    return rows.select(
        F.when(lost, F.lit("")).otherwise(F.col("incident_id")).alias("incident_id"), "pos",
        "file_order", "analysis_type", "analysis", "summary", "behavior_analysis",
        "cause_analysis", "risk_assessment",
        # Each file names itself in the metadata, so the first one shows.
        F.when(F.col("file_order") != 1, F.col("category")).alias("category"),
        F.concat(F.lit("10.0.0."), F.col("file_order").cast("string")).alias("source_ip"),
        F.lit(None).cast("string").alias("timewindow"), F.lit("now").alias("timeline"),
        "threat_level", "event_count",
    )


def merge_inputs(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Three datasets that overlap: status not P, status not F, priority not low."""
    orders = order_incidents(spark, sf).withColumns({
        "source_ip": F.lit("10.0.0.1"), "timewindow": F.lit("1"), "timeline": F.lit("now")})
    cols = ["incident_id", "pos", "category", "source_ip", "timewindow", "timeline",
            "threat_level", "event_count"]
    conditions = [F.col("status") != "P", F.col("status") != "F", F.col("priority") != "5-LOW"]
    return [
        orders.where(c).select(*cols, F.lit(f"in{i}.json").alias("source_file"))
        for i, c in enumerate(conditions)
    ]


def judge_results(spark: SparkSession, sf: str) -> DataFrame:
    """Four models judged per order; the last one has no result where the status is P."""
    def scored(i: int, model: str) -> Column:
        score = 1 + (F.col("pos") * 7 + F.col("custkey") * 5 + i * 3) % 10
        return F.struct((-score).alias("negative"), F.lit(model).alias("model"))

    models = [scored(i, m) for i, m in enumerate(MODELS)]
    last = F.when(F.col("status") != "P", models[-1])
    order = F.array_sort(F.array_compact(F.array(*models[:-1], last)))
    places = F.transform(F.sequence(F.lit(1), F.size("o")), lambda i: i.cast("string"))
    return order_incidents(spark, sf).withColumn("o", order).select(
        "incident_id",
        F.when(F.col("custkey") % 50 == 7, "Unknown").otherwise(F.col("category")).alias("category"),
        "event_count", "threat_level",
        F.map_from_arrays(places, F.transform("o", lambda s: s["model"])).alias("rankings"),
        F.map_from_arrays(F.transform("o", lambda s: s["model"]),
                          F.transform("o", lambda s: (-s["negative"]).cast("double"))).alias("scores"),
    )


# ---- prompt tests over lineitem, part, supplier -----------------------------------------------

def eval_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("openai:chat:model-"), F.col("l_suppkey").cast("string")).alias("provider"),
        F.col("l_partkey").alias("eval_id"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("passed"),
        F.when(F.col("l_quantity") > 25, 0).otherwise(1).alias("failed"),
    )


def eval_meta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("eval_id"), F.col("p_brand").alias("suite"))


def serving_bench(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("model-"), F.col("s_suppkey").cast("string")).alias("model"),
        F.lit("Q4").alias("quantization"),
        (F.floor("s_acctbal") / F.lit(700.0)).alias("tokens_per_second"),
    )


# ---- replies and flows over events ------------------------------------------------------------

def signature_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies holding signatures, right and wrong in turn."""
    eid, k = F.col("event_id").cast("string"), F.col("k")

    def sig(name: str) -> Column:
        return F.concat(F.lit(f"signature {name}-"), eid, F.lit(" {\n  ip-proto == tcp\n\n  dst-port == "),
                        (k + 1).cast("string"), F.lit("\n  payload /GET .*"), k.cast("string"),
                        F.lit('/i\n  event "seen '), F.col("event_type"), F.lit('"\n}'))

    text = _case(k % 8, {
        0: F.concat(F.lit("```plaintext\n"), sig("fenced"), F.lit("\n```")),
        1: F.concat(F.lit("rule x { condition = "), eid, F.lit(" }")),
        2: F.concat(sig("open"), F.lit("\n{")),
        3: F.concat(F.lit("signature {\n ip-proto == udp\n}\n"), eid),
        4: F.concat(F.lit("Here you are:\n\n"), sig("first"), F.lit("\n\n"), sig("second")),
        5: F.concat(F.lit("signature bare-"), eid, F.lit(" {\n nothing\n}")),
        6: F.lit(" \n "),
    })
    return event_base(spark, sf).select("event_id", "event_type", F.coalesce(text, sig("plain")).alias("reply"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return event_base(spark, sf).select(
        "event_id", F.when(k % 2 == 0, "tcp").otherwise("udp").alias("proto"),
        F.concat(F.lit("10."), (F.col("user_id") % 7).cast("string"), F.lit(".0."),
                 (F.col("user_id") % 250).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.0."), (k % 3).cast("string")).alias("dst_ip"),
        (k + 1000).alias("src_port"), _case(k % 3, {0: 53, 1: 80}, 443).alias("dst_port"),
        F.concat_ws(" ", F.upper("event_type"), k.cast("string")).alias("payload"),
    )


def test_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs for two suites: texts, JSON, JSON inside words, broken JSON."""
    k, kind = F.col("k"), F.col("event_type")
    document = F.concat(F.lit('{"action": "'), kind, F.lit('", "parameters": {"host": "10.0.0.'),
                        k.cast("string"), F.lit('", "port": '), k.cast("string"), F.lit("}}"))
    text = _case(k % 4, {
        0: document, 1: F.concat(F.lit("Sure: "), document, F.lit(" done")),
        2: F.concat(F.lit('{"action": "'), kind, F.lit('"}')),
    }, F.lit("no document"))
    return event_base(spark, sf).select(
        F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("provider"),
        F.when(F.col("w") < 2, "format").otherwise("content").alias("suite"),
        F.col("event_id").alias("run"), F.lit("first").alias("test"), text.alias("output"),
    )


ASSERTIONS = [
    {"suite": "format", "test": "first", "type": "is-json", "value": {
        "type": "object", "required": ["action", "parameters"], "properties": {
            "action": {"type": "string", "enum": ["click", "view", "error"]},
            "parameters": {"type": "object", "required": ["host"], "properties": {
                "host": {"type": "string"}, "port": {"type": "number"}}}}}},
    {"suite": "format", "test": "first", "type": "contains-json", "value": {
        "type": "object", "required": ["parameters"], "properties": {
            "parameters": {"type": "object", "properties": {
                "host": {"type": "string", "pattern": r"^10\.0\.0\.[1-4]"}}}}}},
    {"suite": "content", "test": "first", "type": "contains", "value": "action"},
    {"suite": "content", "test": "first", "type": "icontains-all", "value": ["ACTION", "Host"]},
    {"suite": "content", "test": "first", "type": "regex", "value": r"host\": \"10\.0\.0\.\d\d"},
]


def judge_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Judge replies by label for every order, some of them no JSON, one label unknown."""
    key = F.col("pos")
    labels = ["A", "B", "C", "D"]
    first = F.get(F.array(*[F.lit(v) for v in labels]), (key % 4).cast("int"))
    second = F.get(F.array(*[F.lit(v) for v in labels]), ((key + 1) % 4).cast("int"))
    reply = F.concat(
        F.lit('{"rankings": {"1": "'), first, F.lit('", "2": "'), second, F.lit('", "3": "Z"}, "scores": {"'),
        first, F.lit('": '), (key % 10).cast("string"), F.lit(', "'), second,
        F.lit('": 2.5}, "justification": "because '), key.cast("string"), F.lit('"}'))
    return order_incidents(spark, sf).select(
        "incident_id", F.when(F.col("status") == "P", F.lit("no idea")).otherwise(reply).alias("reply"))
