"""Prompts out of tables, replies back into tables. The model itself is a function of the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions import text as X
from alertloom.functions.maps import map_of_last
from alertloom.functions.once import evaluated_once
from alertloom.operators.incidents import incident_header, record_keys
from alertloom.schemas import JUDGE_REPLY

_INCIDENT = """Incident {{incident_id}}
Source: {{source_ip}} | time window {{timewindow}} | threat level {{threat_text}}
Time: {{started}} to {{until}} | events: {{event_count}}

Evidence:
{{evidence}}
"""

# The headings a reply must carry are fixed: section_columns reads them back.
TEMPLATES = {
    "summary": _INCIDENT + """
Summarise this incident in plain words for an analyst. Merge events that say the same, give a time
or a time range and a severity (CRITICAL, HIGH, MEDIUM, LOW, INFO) to each line, and close with the
number of events and a count per severity.""",
    "behavior": _INCIDENT + """
Describe the network behaviour in this order:
**Source:** {{source_ip}}
**Activity:** the kind of activity
**Detected Flows:** one line per flow, source and port to destination and service
**Summary:** one or two sentences""",
    "cause": _INCIDENT + """
Name what may have caused this, under these headings:
**Possible Causes:**
**1. Malicious Activity:**
**2. Legitimate Activity:**
**3. Misconfigurations:**
**Conclusion:** the likeliest kind of cause and what to look into next""",
    "risk": _INCIDENT + """
Assess the risk, one line per heading:
**Risk Level:** Critical, High, Medium or Low
**Justification:** why
**Business Impact:** the main effect
**Likelihood of Malicious Activity:** High, Medium or Low, and why
**Investigation Priority:** Immediate, High, Medium or Low, and why""",
    "judge": """Rank the analyses {{labels}} of one security incident from best to worst.
The incident is known to be: {{category}}

Evidence:
{{evidence}}

{{candidates}}

Answer with JSON only: "rankings" maps each place from "1" to a label, "scores" maps each label to
1-10, "justification" says why.""",
    "signature": """Write one detection signature.
Threat: {{threat}}
Protocol: {{protocol}}
Kind: {{complexity}}
Setting: {{context}}
Also: {{requirement}}
{{document}}
Start with the keyword signature, end with the closing brace, add nothing else.""",
    "variation": """Write {{count}} variations of this signature. {{strategy_text}}

{{signature}}

Keep the name's stem, give each its own ending, and separate them by blank lines.""",
}

STRATEGIES = {
    "broader": "Each should match more traffic than the original.",
    "stricter": "Each should match less traffic than the original.",
    "mixed": "Some should match more traffic than the original and some less.",
}

# The choices signature prompts are drawn from.
DIMENSIONS = {
    "threat": [
        "malware command and control communication", "SQL injection attack",
        "cross-site scripting (XSS) payload", "remote code execution attempt", "brute force login attack",
        "DNS tunneling activity", "data exfiltration over HTTP", "port scanning behavior",
        "cryptocurrency mining malware", "ransomware communication", "phishing email content",
        "backdoor communication", "privilege escalation attempt", "buffer overflow exploit",
        "web shell upload", "credential harvesting", "lateral movement activity",
        "suspicious file download", "covert channel communication", "botnet activity",
    ],
    "protocol": ["HTTP", "HTTPS", "DNS", "SSH", "FTP", "SMTP", "TCP", "UDP", "TLS", "SMB", "ICMP"],
    "complexity": [
        "simple payload pattern matching", "multi-field condition matching (IP, port, and payload)",
        "stateful TCP connection analysis", "HTTP header and body analysis",
        "regex-based content detection", "binary payload signature matching",
    ],
    "context": [
        "enterprise network environment", "web server infrastructure", "DNS server traffic",
        "email server communications", "IoT device network", "cloud infrastructure",
        "remote access connections", "internal network traffic",
    ],
    "requirement": [
        "include proper signature metadata and event description",
        "use appropriate port matching for the protocol",
        "implement case-insensitive pattern matching",
        "include both source and destination criteria",
        "use efficient regex patterns to avoid performance issues",
        "provide descriptive event messages for analysts",
    ],
}

NOT_AVAILABLE = "N/A"


def incident_prompts(incidents: DataFrame, evidence: DataFrame, counts: DataFrame, kind: str,
                     template: str | None = None) -> DataFrame:
    """One prompt for each incident, from its evidence text and event count."""
    keys = record_keys(incidents)
    fields = (
        incident_header(incidents).join(counts, keys).join(evidence.drop("lines"), keys)
        .withColumn("until", F.when(F.col("ended") != "", F.col("ended")).otherwise("ongoing"))
        .withColumnRenamed("text", "evidence")
    )
    # Evidence comes last so that braces inside it are left alone.
    names = ("incident_id", "source_ip", "timewindow", "threat_text", "started", "until",
             "event_count", "evidence")
    prompt = X.filled(template or TEMPLATES[kind], {n: F.col(n) for n in names})
    return fields.select(*keys, prompt.alias("prompt"))


def judge_prompts(df: DataFrame, evidence_col: str, analyses_col: str = "analyses",
                  template: str | None = None) -> DataFrame:
    """Prompts that show the analyses of an incident under their shuffled labels.

    ``analyses_col`` maps model to text; ``randomization`` maps label to model.
    """
    def block(entry: Column) -> Column:
        text = F.coalesce(F.try_element_at(F.col(analyses_col), entry["value"]), F.lit(NOT_AVAILABLE))
        return F.concat(F.lit("### "), entry["key"], F.lit("\n"), text)

    entries = F.array_sort(F.map_entries("randomization"))
    prompt = X.filled(template or TEMPLATES["judge"], {
        "labels": F.array_join(F.transform(entries, lambda e: e["key"]), ", "),
        "category": F.col("category"),
        "candidates": F.array_join(F.transform(entries, block), "\n\n"),
        "evidence": F.coalesce(F.col(evidence_col), F.lit(NOT_AVAILABLE)),
    })
    return df.withColumn("prompt", prompt)


def signature_prompts(grid: DataFrame, document: str | None = None) -> DataFrame:
    """Prompts from rows that hold a choice for threat, protocol, complexity, context, requirement."""
    names = ("threat", "protocol", "complexity", "context", "requirement")
    values = {n: F.col(n) for n in names}
    values["document"] = F.lit(f"Reference:\n{document}" if document else "")
    return grid.withColumn("prompt", X.filled(TEMPLATES["signature"], values))


def variation_prompts(signatures: DataFrame, strategy: str = "mixed", count: int = 5) -> DataFrame:
    strategy = strategy if strategy in STRATEGIES else "mixed"
    return signatures.withColumn("prompt", X.filled(TEMPLATES["variation"], {
        "count": F.lit(count), "strategy_text": F.lit(STRATEGIES[strategy]),
        "signature": F.col("signature"),
    }))


def apply_model(df: DataFrame, prompt_col: str, model: Callable[[str], str], on_error: str = "keep",
                failure: str = "query failed: {error}") -> DataFrame:
    """Adds ``reply`` and ``error``. One call per row, in Arrow batches; a failing call leaves its
    message as reply (``keep``) or loses its row (``drop``).

    Calls may repeat after a lost executor; write the result before using it twice.
    """
    if on_error not in ("keep", "drop"):
        raise ValueError("on_error is keep or drop")

    def call(prompt: str) -> tuple[str, str | None]:
        try:
            return model(prompt), None
        except Exception as e:  # the caller's function may raise anything
            return failure.format(error=e), str(e)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [call(p) for p in frame[prompt_col]]
            frame["reply"] = [a[0] for a in answers]
            frame["error"] = [a[1] for a in answers]
            yield frame if on_error == "keep" else frame[frame["error"].isna()]

    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()),
                           T.StructField("error", T.StringType())])
    return df.mapInPandas(batches, schema)


def token_count(text: Column, encode: Callable[[str], list] | None) -> Column:
    """Tokens by the caller's encoder; 0 where there is none or it fails."""
    if encode is None:
        return F.lit(0)

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        def size(value: str | None) -> int:
            try:
                return len(encode(value)) if value is not None else 0
            except Exception:  # as above
                return 0
        return texts.map(size).astype("int32")

    return counted(text)


def judge_replies(df: DataFrame, reply_col: str = "reply", names: dict[str, str] | None = None) -> DataFrame:
    """Rankings, scores and justification of JSON replies, with labels turned back into models.

    A label nobody was given reads ``unknown``. ``names`` maps models to the names to show.
    """
    parsed = F.from_json(reply_col, JUDGE_REPLY)
    shown = F.create_map(*[F.lit(v) for pair in (names or {}).items() for v in pair]) if names else None

    def model(label: Column) -> Column:
        key = F.try_element_at(F.col("randomization"), label)
        return F.try_element_at(shown, key) if shown is not None else key

    entries = F.transform(F.map_entries("_r.scores"), lambda e: F.struct(
        model(e["key"]).alias("k"), e["value"].alias("v")))
    # Models may share a name to show; the last score stays.
    known = map_of_last(F.filter(entries, lambda e: e["k"].isNotNull()), "k", "v")
    # All unknown labels fall on one name; the last score stays.
    last = F.try_element_at(F.filter(entries, lambda e: e["k"].isNull()), F.lit(-1))
    scores = F.when(last.isNull(), known).otherwise(
        F.map_concat(known, F.create_map(F.lit("unknown"), last["v"])))
    empty = F.create_map()
    return evaluated_once(df, {"_r": parsed}).withColumns({
        "rankings": F.coalesce(
            F.transform_values("_r.rankings", lambda _, v: F.coalesce(model(v), F.lit("unknown"))),
            empty.cast("map<string,string>")),
        "scores": F.coalesce(scores, empty.cast("map<string,double>")),
        "justification": F.coalesce("_r.justification", F.lit("")),
    }).drop("_r")


# Headings of cause and risk replies, with the column each goes to.
RISK_HEADINGS = {
    "risk_level": "Risk Level", "justification": "Justification",
    "business_impact": "Business Impact", "likelihood": "Likelihood of Malicious Activity",
    "priority": "Investigation Priority",
}
CAUSE_HEADINGS = {
    "malicious": "1. Malicious Activity", "legitimate": "2. Legitimate Activity",
    "misconfiguration": "3. Misconfigurations", "conclusion": "Conclusion",
}


def section_columns(df: DataFrame, col: str, headings: dict[str, str]) -> DataFrame:
    """The text under each ``**heading:**`` up to the next heading; null if it is not there."""
    def section(heading: str) -> Column:
        name = heading.replace(".", r"\.")
        found = F.regexp_extract(F.col(col), rf"(?s)\*\*{name}:\*\*(.*?)(?=\n\s*\*\*|\z)", 1)
        return F.nullif(X.strip(found), F.lit(""))

    return df.withColumns({name: section(heading) for name, heading in headings.items()})
