"""Whole workflows made of the operators: alerts to reports, alerts to model analyses, a dataset
to judged models, prompts to accepted signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import text as X
from alertloom.operators import incidents as I
from alertloom.operators import prompts as P
from alertloom.operators import sampling as S
from alertloom.operators import signatures as G
from alertloom.session import stored
from alertloom.sources.alerts import Alerts

Model = Callable[[str], str]

# What the model is asked for, the message of a failed call, and whether statistics
# are cut off the reply.
ANALYSES = {
    "summary": ("Incident {incident}: LLM query failed - ", False, False),
    "behavior": ("Behavior analysis failed: ", True, False),
    "cause": ("Cause analysis failed: ", True, True),
    "risk": ("Risk assessment failed: ", True, True),
}


def report_alerts(alerts: Alerts) -> DataFrame:
    """One record per incident with its grouped text."""
    linked = I.link_events(I.explode_links(alerts.incidents), alerts.events)
    return I.incident_report(alerts.incidents, linked)


def model_analyses(incidents: DataFrame, linked: DataFrame, model: Model, kind: str = "summary",
                   grouped: bool = True, template: str | None = None) -> DataFrame:
    """One record per incident with the model's text.

    Grouping the evidence first is what keeps prompts and cost small. A failed call leaves its
    message as text; an incident without events is not asked about.
    """
    failed, cleaned, cut = ANALYSES[kind]
    keys = I.record_keys(incidents)
    counts = linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))
    evidence = I.evidence_text(I.pattern_groups(linked)) if grouped else I.raw_evidence_text(linked)
    prompts = P.incident_prompts(incidents, evidence, counts, kind, template)
    asked = P.apply_model(prompts, "prompt", model)
    message: Column = F.concat(F.replace(F.lit(failed), F.lit("{incident}"), F.col("incident_id")), "error")
    reply = X.clean_reply(F.col("reply"), cut) if cleaned else X.strip(F.col("reply"))
    answers = asked.select(*keys, F.when(F.col("error").isNotNull(), message).otherwise(reply).alias("text"))
    nothing = F.format_string("Incident %s: No associated events found", "incident_id")
    return (
        I.incident_header(incidents)
        .join(counts, keys, "left")
        .join(answers, keys, "left")
        .select(*keys, "source_ip", "timewindow", "timeline", "threat_level", F.coalesce("event_count", F.lit(0)).alias("event_count"),
                F.coalesce("text", nothing).alias(kind))
    )


def judged_results(dataset: DataFrame, models: dict[str, str], judge: Model, target: int = 50,
                   evidence_col: str = "report", seed: int = 42, label_seed: int = 0) -> DataFrame:
    """Judge results of a stratified sample of ``dataset`` (incident_id, pos, category,
    event_count, threat_level, analyses, evidence). ``models`` maps keys of ``analyses`` to names
    to show. A failed call loses its incident."""
    labels = [chr(ord("A") + i) for i in range(len(models))]
    sample = S.stratified_sample(dataset, target, seed)
    shown = S.label_shuffle(sample, list(models), labels, seed=label_seed)
    asked = P.apply_model(
        P.judge_prompts(shown, evidence_col).drop("analyses", evidence_col), "prompt", judge, "drop")
    return P.judge_replies(asked, names=models).select(
        "incident_id", "category", "event_count", "threat_level", "randomization", "rankings",
        "scores", "justification")


def generated_signatures(spark: SparkSession, count: int, model: Model,
                         dimensions: dict[str, list[str]] = P.DIMENSIONS, document: str | None = None,
                         seed: int = 0) -> DataFrame:
    """Up to ``count`` training records with valid signatures. The model is asked ``count`` times, and
    again, at most three times in all, while there are too few. Replies are written once."""
    replies = None
    for tried in range(3):
        attempts = spark.range(tried * count + 1, (tried + 1) * count + 1).select(F.col("id").alias("attempt"))
        prompts = P.signature_prompts(S.prompt_grid(attempts, dimensions, "attempt", seed), document)
        made = stored(G.validate_signatures(P.apply_model(prompts, "prompt", model), "reply"))
        replies = made if replies is None else replies.unionByName(made)
        if replies.where("valid").count() >= count:
            break
    accepted = S.accept_first(replies, count)
    made = accepted.withColumns({
        "instruction": F.concat_ws(" ", F.lit("Write a detection signature for"), "threat"),
        "input": F.concat_ws("; ", "protocol", "complexity", "context", "requirement"),
    })
    return G.training_example(made)
