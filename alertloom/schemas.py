"""Schemas of the files the package reads and the tables it hands between operators."""

from __future__ import annotations

ENDPOINT = "array<struct<IP:string,Port:array<int>>>"

# One JSON line of an alert file. Incidents and events share the line format and differ by Status.
ALERT_LINE = (
    f"Status string, ID string, Severity string, StartTime string, CreateTime string, "
    f"Confidence double, Description string, Source {ENDPOINT}, Target {ENDPOINT}, "
    f"CorrelID array<string>, Note string, category string, _corrupt string"
)

# The keys of the Note string that are used downstream.
NOTE = "timewindow string, accumulated_threat_level string, EndTime string, threat_level string"

# One record of an analysis file. Producers fill different payload fields.
ANALYSIS = (
    "struct<incident_id:string,category:string,source_ip:string,timewindow:string,"
    "timeline:string,threat_level:double,event_count:bigint,analysis:string,summary:string,"
    "behavior_analysis:string,cause_analysis:string,risk_assessment:string>"
)

REQUIRED_FIELDS = (
    "incident_id", "category", "source_ip", "timewindow", "timeline", "threat_level", "event_count",
)

JUDGE_RESULT = (
    "incident_id string, category string, event_count bigint, threat_level double, "
    "randomization map<string,string>, rankings map<string,string>, scores map<string,double>, "
    "justification string"
)

JUDGE_REPLY = "rankings map<string,string>, scores map<string,double>, justification string"

SERVING_BENCHMARK = (
    "model string, quantization string, disk_size_mb double, ram_size_mb double, "
    "tokens_per_second double"
)

EVAL_RUN = "ID string, Created string, Description string, `Pass Rate` double, `# Tests` int"

RANK_TABLE = "provider string, score double"

TURNS = "array<struct<role:string,content:string>>"
