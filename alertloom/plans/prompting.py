"""Queries over the default prompts, alert files found in folders, signature files and kinds of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import datasets as D
from alertloom.operators import incidents as I
from alertloom.operators import prompts as P
from alertloom.operators import sampling as S
from alertloom.operators import signatures as G
from alertloom.plans import inputs as N
from alertloom.plans import texts
from alertloom.plans.alerts import EVENTS_SQL
from alertloom.plans.datasets import RECORDS_SQL
from alertloom.session import new_folder
from alertloom.sinks import files as K
from alertloom.sources import alerts as A
from alertloom.sources.analyses import dataset_kind

CHOICES = {"threat": ["botnet", "tunnel", "scan"], "protocol": ["HTTP", "DNS", "SSH"], "complexity": ["plain", "stateful"],
           "context": ["office", "cloud"], "requirement": ["named", "quiet", "fast"]}
DOCUMENT = "Signatures start with their keyword."


def _prompts(spark, sf, kind: str):
    linked = I.link_events(N.alert_links(spark, sf), N.alert_events(spark, sf))
    counts = linked.groupBy("incident_id").agg(F.count(F.lit(1)).alias("event_count"))
    return P.incident_prompts(N.alert_incidents(spark, sf), I.raw_evidence_text(linked), counts, kind)


def behavior_prompts(spark, sf):
    return _prompts(spark, sf, "behavior")


def risk_prompts(spark, sf):
    return _prompts(spark, sf, "risk")


def signature_prompts(spark, sf):
    """A prompt for each part, from choices drawn by its key, with a reference document."""
    grid = S.prompt_grid(N.table(spark, sf, "part").select("p_partkey"), CHOICES, "p_partkey", seed=1)
    return P.signature_prompts(grid, DOCUMENT).select("p_partkey", "prompt")


def discovered_alerts(spark, sf):
    """Event lines in files of folders by category; files of another name and folders beside these are not read."""
    path = new_folder(spark)
    category = F.when(F.col("w") % 3 == 0, "Normal").when(F.col("w") % 3 == 1, "Malware").otherwise("Other")
    rows = N.event_base(spark, sf).select(category.alias("category"), (F.col("b") % 4).alias("part"), F.format_string(
        '{"Status": "Event", "ID": "%d"}', "event_id").alias("value"))
    rows.repartition("category", "part").write.partitionBy("category", "part").text(path)
    # Spark names the files it writes; the layout has a fixed name in each folder.
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    store = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/category=*/part=*/part-*")):
        folder = found.getPath().getParent()
        name = "other.json" if folder.getName() == "part=3" else "alerts.json"
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/data/{folder.getParent().getName().removeprefix('category=')}/{folder.getName()}")
        store.mkdirs(target)
        store.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(target, name))
    alerts = A.discover_alerts(spark, f"{path}/data")
    return alerts.events.select("event_id", F.regexp_extract("source_file", "/data/([A-Za-z]+)/", 1).alias("category"))


def signature_text(spark, sf):
    """The valid replies written as signature text, a blank line after each, and read back."""
    path = new_folder(spark)
    valid = G.validate_signatures(N.signature_replies(spark, sf), "reply").where("valid").select("cleaned", "event_id")
    K.write_signatures(valid, path, "cleaned", order=["event_id"])
    return spark.read.option("lineSep", "\n\n").text(path).select(F.md5("value").alias("text_md5"))


def dataset_kinds(spark, sf):
    """What wide datasets are about, told by their columns, with the number of their incidents."""
    records = N.analysis_records(spark, sf).withColumn("payload", D.payload())
    found = None
    for types in (["dag", "llm_small"], ["cause_risk_small"], ["dag"]):
        wide = D.wide(D.correlate(records.where(F.col("analysis_type").isin(*types))), types)
        part = wide.agg(F.count(F.lit(1)).alias("incidents")).select(F.lit(types[0]).alias("first_type"), F.lit(dataset_kind(wide.columns)).alias("kind"), "incidents")
        found = part if found is None else found.union(part)
    return found


QUERIES = {f.__name__: f for f in (behavior_prompts, risk_prompts, signature_prompts, discovered_alerts, signature_text, dataset_kinds)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled_sql(template: str, fields: dict[str, str]) -> str:
    """A template whose named places are replaced one after the other."""
    text = _quoted(template)
    for name, value in fields.items():
        text = f"replace({text}, '{{{{{name}}}}}', {value})"
    return text


def _prompt_sql(kind: str) -> str:
    fields = {n: n for n in ("incident_id", "source_ip", "timewindow", "threat_text", "started", "until", "event_count", "evidence")}
    return f"""WITH {EVENTS_SQL},
        h AS (SELECT incident_id, '10.0.0.' || b AS source_ip, CAST(any_value(w) AS VARCHAR) AS timewindow,
                     CAST(CAST((CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // 100) / 100.0 AS DOUBLE) AS VARCHAR) AS threat_text,
                     strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS until,
                     CAST(count(*) AS VARCHAR) AS event_count,
                     string_agg(short || ' | ' || description, chr(10) ORDER BY pos) AS evidence FROM alert GROUP BY incident_id, b)
        SELECT incident_id, {_filled_sql(P.TEMPLATES[kind], fields)} AS prompt FROM h"""


def _signature_sql() -> str:
    fields = {}
    for name, values in CHOICES.items():
        draw = f"CAST('0x' || substr(md5('1|{name}|' || p_partkey), 1, 8) AS BIGINT)"
        fields[name] = f"([{', '.join(map(_quoted, values))}])[1 + {draw} % {len(values)}]"
    fields["document"] = _quoted(f"Reference:\n{DOCUMENT}")
    return f"SELECT p_partkey, {_filled_sql(P.TEMPLATES['signature'], fields)} AS prompt FROM part"


def _kind_sql(first: str, kind: str, names: str) -> str:
    return f"SELECT '{first}' AS first_type, '{kind}' AS kind, count(DISTINCT incident_id) AS incidents FROM valid WHERE kind IN ({names})"


ORACLES = {
    "dataset_kinds": f"""WITH {RECORDS_SQL} {_kind_sql("dag", "summarisation", "'dag', 'llm_small'")}
        UNION ALL {_kind_sql("cause_risk_small", "risk", "'cause_risk_small'")} UNION ALL {_kind_sql("dag", "unknown", "'dag'")}""",
    "behavior_prompts": _prompt_sql("behavior"),
    "risk_prompts": _prompt_sql("risk"),
    "signature_prompts": _signature_sql(),
    "discovered_alerts": f"""WITH {EVENTS_SQL}
        SELECT CAST(event_id AS VARCHAR) AS event_id, CASE w % 3 WHEN 0 THEN 'Normal' ELSE 'Malware' END AS category FROM ev WHERE w % 3 < 2 AND b % 4 < 3""",
    "signature_text": f"""WITH c AS ({texts.ORACLES["signature_clean"]}), v AS ({texts.ORACLES["signature_validate"]})
        SELECT md5(cleaned) AS text_md5 FROM c JOIN v USING (event_id) WHERE valid""",
}
