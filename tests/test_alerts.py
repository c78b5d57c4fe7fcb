"""Edge rows of reading, times, patterns, groups and reports."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from alertloom.functions import alerts as A
from alertloom.functions import text as X
from alertloom.functions import times as T
from alertloom.operators import incidents as I
from alertloom.sources import alerts as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def alert_dir(tmp_path_factory):
    base = tmp_path_factory.mktemp("store") / "datasets"
    lines = [
        json.dumps({"Status": "Incident", "ID": "i1", "Severity": "HIGH", "Source": [{"IP": "10.0.0.1"}],
                    "StartTime": "2024-01-01T10:00:00+02:00", "CorrelID": ["e1", "e2", "e1", "gone"],
                    "Note": json.dumps({"timewindow": 3, "accumulated_threat_level": 15.36,
                                        "EndTime": "2024-01-01T11:30:00+02:00"})}),
        json.dumps({"Status": "Incident", "ID": "i2", "CorrelID": [], "Note": "no json"}),
        "", "   ", "{bad", "[1]", json.dumps({"Status": "Test"}),
        json.dumps({"Status": "Event", "ID": "e1", "Description": "old", "StartTime": "2024-01-01T08:00:00Z"}),
        '{"Status": "Event", "ID": "e2", "Severity": "High", "Confidence": NaN, "Description": "scan",'
        ' "StartTime": "2024-01-01T23:59:00Z", "Target": [{"IP": "1.1.1.1", "Port": [80, 81]}, {"Port": [82]}]}',
        json.dumps({"Status": "Event", "Description": "no id", "Note": ""}),
        json.dumps({"Status": "Event", "ID": "e1", "Severity": "Low", "Description": "new one",
                    "StartTime": "2024-01-02T00:01:00Z", "Target": [{"IP": "2.2.2.2"}]}),
    ]
    for category, name in (("Normal", "n1"), ("Malware", "m1")):
        folder = base / category / "set1" / name / "tw2"
        folder.mkdir(parents=True)
        (folder / "alerts.json").write_text("\n".join(lines))
    (base / "Malware" / "other.json").write_text("{}")
    return base


def test_reading_routes_lines(spark, alert_dir):
    path = str(alert_dir / "Normal/set1/n1/tw2/alerts.json")
    alerts = S.read_alerts(spark, path)
    assert {r["kind"]: r["lines"] for r in S.parse_counts(alerts).collect()} == {
        "incident": 2, "event": 4, "bad json": 1, "bad record": 1, "unknown status": 1}
    incident = alerts.incidents.where("incident_id = 'i1'").first()
    assert incident["correl_ids"] == ["e1", "e2", "e1", "gone"]
    assert (incident["timewindow"], incident["threat_level"]) == ("3", "15.36")
    assert alerts.incidents.where("incident_id = 'i2'").first()["note"] == {"raw": "no json"}
    event = alerts.events.where("event_id = 'e2'").first()
    assert event["target_ips"] == ["1.1.1.1"] and event["target_ports"] == [80, 81, 82]
    assert event["confidence"] != event["confidence"]
    nameless = alerts.events.where("event_id = ''").first()
    assert (nameless["severity"], nameless["confidence"], nameless["note"]) == ("Unknown", 0.0, {})


def test_discovery_prunes_by_category(spark, alert_dir):
    everything = S.discover_alerts(spark, str(alert_dir))
    assert everything.incidents.count() == 4
    normal = S.path_metadata(S.discover_alerts(spark, str(alert_dir), "normal").incidents, "datasets")
    row = normal.first()
    assert (row["path_category"], row["path_dataset"], row["path_capture"], row["path_timewindow"]) == \
        ("Normal", "set1", "n1", "tw2")
    with pytest.raises(ValueError):
        S.discover_alerts(spark, str(alert_dir), "odd")
    elsewhere = S.path_metadata(spark.createDataFrame([Row(source_file="/a/b")]), "datasets").first()
    assert elsewhere["path_category"] == "unknown"


def test_links_keep_order_and_repeats(spark, alert_dir):
    alerts = S.read_alerts(spark, str(alert_dir / "Normal/set1/n1/tw2/alerts.json"))
    links = I.explode_links(alerts.incidents)
    linked = I.link_events(links, alerts.events).orderBy("pos").collect()
    assert [(r["pos"], r["description"]) for r in linked] == [(0, "new one"), (1, "scan"), (2, "new one")]
    assert [r["event_id"] for r in I.missing_events(links, alerts.events).collect()] == ["gone"]
    counts = I.link_counts(links, alerts.events).first()
    assert (counts["total_event_ids"], counts["num_events"], counts["missing_events"]) == (4, 3, 1)


def test_file_scope_ignores_other_files_and_nameless_events(spark, alert_dir):
    alerts = S.discover_alerts(spark, str(alert_dir))
    links = I.explode_links(alerts.incidents, "file")
    assert I.link_events(links, alerts.events, "file").count() == 6
    strangers = alerts.events.withColumn("source_file", F.lit("x"))
    assert I.link_events(links, strangers, "file").count() == 0
    assert S.last_events(alerts.events, "file").count() == 4
    assert S.last_events(alerts.events).count() == 3


def test_last_line_wins_across_splits(spark, tmp_path):
    lines = [json.dumps({"Status": "Event", "ID": str(i % 7), "Description": str(i)}) for i in range(5000)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        events = S.read_alerts(spark, str(tmp_path / "a.json")).events
        assert events.rdd.getNumPartitions() > 3
        kept = {r["event_id"]: int(r["description"]) for r in S.last_events(events).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert kept == {str(i % 7): i for i in range(4993, 5000)}


def test_find_incident(spark, alert_dir):
    alerts = S.read_alerts(spark, str(alert_dir / "Normal/set1/n1/tw2/alerts.json"))
    assert I.find_incident(alerts.incidents, "i2").count() == 1
    with pytest.raises(LookupError):
        I.find_incident(alerts.incidents, "i3")


@pytest.mark.parametrize("text, long, short", [
    ("1970-01-01T00:00:13.676697+00:00", "1970-01-01 00:00:13", "00:00"),
    ("1970-01-01T00:00:13.676697Z", "1970-01-01 00:00:13", "00:00"),
    ("2024-01-01T10:00:00+02:00", "2024-01-01 10:00:00", "10:00"),
    ("2024-02-30T10:00:00", "2024-02-30T10:00:00", "2024-02-30T10:00:00"),
    ("nope", "nope", "nope"), ("", "", ""), ("2024", "2024", "2024"),
])
def test_times_are_wall_clock(spark, text, long, short):
    assert one(spark, T.format_time(F.lit(text))) == long
    assert one(spark, T.format_time(F.lit(text), short=True)) == short


def test_times_do_not_move_with_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # This clock time is skipped in that zone.
        assert one(spark, T.format_time(F.lit("2024-03-10T02:30:00Z"))) == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("text, pattern", [
    ("Connection to 1.2.3.4:443", "Connection to <IP>:<NUM>"),
    ("port scan to port 443/TCP. 50 unique dst IPs", "port scan to port <PORT>/TCP. <NUM> unique dst IPs"),
    ("ports: 80-90 and Port 22, 53/udp", "port <PORT> and port <PORT>, <PORT>/UDP"),
    ("x_5 5_x", "x_5 5_x"),
    ("12.5% of 1.2.3.4.5", "<NUM>.<NUM>% of <IP>.<NUM>"),
    ("report 77", "report <PORT>"),
    ("٥٦ and １", "<NUM> and <NUM>"),
    ("fd2d:ab8c:225::1", "fd2d:ab8c:<NUM>::<NUM>"),
])
def test_pattern_normalising(spark, text, pattern):
    assert one(spark, X.normalise_pattern(F.lit(text))) == pattern


def test_sample_values(spark):
    text = "1.1.1.1 2.2.2.2 3.3.3.3 on 80/tcp 81/UDP 82/TCP"
    assert one(spark, X.sample_values(F.lit(text))) == ["1.1.1.1", "2.2.2.2", "80/tcp", "81/UDP"]


@pytest.mark.parametrize("ips, ports, description, target", [
    (["1.1.1.1"], [80], "d", "1.1.1.1:80"), (["1.1.1.1", "2.2.2.2"], [80, 81], "d", "2 IPs:2 ports"),
    (["1.1.1.1"], [], "d", "1.1.1.1"), ([], [80], "d", "port 80"), ([], [80, 81], "d", "2 ports"),
    ([], [], "two words", "two"), ([], [], "", "Unknown"),
])
def test_target_summary(spark, ips, ports, description, target):
    row = spark.createDataFrame([(ips, ports, description)], "ips array<string>, ports array<int>, d string")
    assert row.select(A.target_summary(F.col("ips"), F.col("ports"), F.col("d"))).first()[0] == target


def _linked(spark, rows):
    return spark.createDataFrame(
        [(i, p, s, t, d, ips, ports) for i, p, s, t, d, ips, ports in rows],
        "incident_id string, pos bigint, severity string, start_time string, description string, "
        "target_ips array<string>, target_ports array<int>")


def _incidents(spark):
    return spark.createDataFrame(
        [("i1", ["10.0.0.9"], "2", "7.5", "2024-01-01T23:00:00Z", ""),
         ("i2", [], None, None, "", "")],
        "incident_id string, source_ips array<string>, timewindow string, threat_level string, "
        "start_time string, end_time string")


EVENTS = [
    ("i1", 0, "Info", "2024-01-01T23:59:00Z", "a", ["1.1.1.1"], [80]),
    ("i1", 1, "High", "2024-01-02T00:01:00Z", "b", ["2.2.2.2"], []),
    ("i1", 2, "Info", "2024-01-02T00:01:00Z", "c", ["1.1.1.1"], [80]),
    ("i1", 3, "Odd", "", "d", [], []),
    ("i1", 4, "Info", "2024-01-02T00:01:00Z", "c", ["1.1.1.1"], [80]),
    ("i1", 5, "Info", "2024-01-02T00:01:00Z", "e", ["1.1.1.1"], [80]),
    ("i1", 6, "Info", "2024-01-02T00:01:00Z", "f", ["1.1.1.1"], [80]),
]

REPORT = """============================================================
Incident: i1
Source IP: 10.0.0.9 | Timewindow: 2
Start Time: 2024-01-01 23:00:00
Threat Level: 7.5 | Events: 7

• 00:01 - Event to 2.2.2.2 [HIGH]
  - b
• 00:01-23:59 - 5 events to 1.1.1.1:80 [INFO]
  - c (x2)
  - a
  - e
  - ... and 1 more variations
• Unknown - Event to d [ODD]
  - d

Total Evidence: 7 events
Severity breakdown: High: 1, Info: 5, Odd: 1"""


def test_report_text(spark):
    rows = {r["incident_id"]: r for r in I.incident_report(_incidents(spark), _linked(spark, EVENTS)).collect()}
    assert rows["i1"]["analysis"] == REPORT
    assert (rows["i1"]["event_count"], rows["i1"]["threat_level"], rows["i1"]["timeline"]) == \
        (7, 7.5, "2024-01-01 23:00:00")
    assert rows["i2"]["analysis"] == "Incident i2: No associated events found"
    assert (rows["i2"]["source_ip"], rows["i2"]["timewindow"], rows["i2"]["threat_level"]) == \
        ("Unknown", "Unknown", 0.0)


def test_records_with_one_id_stay_apart(spark):
    """Two records of one incident id, each with an event of its own."""
    lines = [{"Status": "Event", "ID": "e1", "Severity": "Low", "Description": "one"},
             {"Status": "Event", "ID": "e2", "Severity": "High", "Description": "two"},
             {"Status": "Incident", "ID": "i", "CorrelID": ["e1"]}, {"Status": "Incident", "ID": "i", "CorrelID": ["e2", "e2"]}]
    rows = spark.createDataFrame([(json.dumps(x), "f", n) for n, x in enumerate(lines)], "line string, source_file string, line_order int")
    alerts = S.parse_lines(rows)
    linked = I.link_events(I.explode_links(alerts.incidents), alerts.events)
    reports = I.incident_report(alerts.incidents, linked).orderBy("record").collect()
    assert [(r["incident_id"], r["event_count"]) for r in reports] == [("i", 1), ("i", 2)]
    assert "one" in reports[0]["analysis"] and "two" not in reports[0]["analysis"]
    assert [r["text"] for r in I.raw_evidence_text(linked).orderBy("record").collect()] == [" | one", " | two\n | two"]
    assert I.pattern_groups(linked).count() == 2


def test_words_after_a_record_are_no_record(spark):
    event = json.dumps({"Status": "Event", "ID": "e"})
    lines = [event, event + " trailing", event + event, event + ", " + event, f"  {event} "]
    rows = spark.createDataFrame([(x.strip(), "f", n) for n, x in enumerate(lines)], "line string, source_file string, line_order int")
    alerts = S.parse_lines(rows)
    assert alerts.events.count() == 2 and [r["reason"] for r in alerts.rejects.collect()] == ["bad json"] * 3
    assert {r["kind"]: r["lines"] for r in S.parse_counts(alerts).collect()} == {"event": 2, "bad json": 3}


def test_true_ends_beside_the_text_range(spark):
    group = I.incident_groups(_linked(spark, EVENTS)).where("events = 5").first()
    assert group["time_range"] == "00:01-23:59"
    assert str(group["first_at"]) < str(group["last_at"])


def test_pattern_groups_and_evidence(spark):
    rows = [
        ("i", 0, "Low", "2024-01-01T10:05:00Z", "to 1.1.1.1", [], []),
        ("i", 1, "Low", "2024-01-01T10:01:00Z", "to 2.2.2.2", [], []),
        ("i", 2, "Low", "2024-01-01T10:03:00Z", "to 1.1.1.1", [], []),
        ("i", 3, "Low", "2024-01-01T10:04:00Z", "to 4.4.4.4", [], []),
        ("i", 4, "Low", "2024-01-01T09:00:00Z", "alone", [], []),
        ("i", 5, "Low", "2024-01-01T11:00:00Z", "n 1", [], []),
        ("i", 6, "Low", "2024-01-01T11:00:00Z", "n 2", [], []),
    ]
    groups = I.pattern_groups(_linked(spark, rows))
    text = I.evidence_text(groups).first()["text"]
    assert text == ("10:01-10:05 | to 2.2.2.2 (4x similar, samples: 2.2.2.2, 1.1.1.1, 4.4.4.4)\n"
                    "11:00 | n 1 (2x similar, samples: various)\n09:00 | alone")
    raw = I.raw_evidence_text(_linked(spark, rows), range_width=3).collect()
    assert [r["lines"] for r in raw] == [7]
    assert raw[0]["text"].startswith("10:05 | to 1.1.1.1\n10:01 | to 2.2.2.2\n10:03 | to 1.1.1.1\n10:04")
    tokens = I.size_reduction(groups, _linked(spark, rows), lambda c: F.size(F.split(c, " "))).first()
    assert (tokens["events"], tokens["patterns"], tokens["raw_tokens"]) == (7, 3, 27)


def test_reply_cleanup(spark):
    assert one(spark, X.clean_reply(F.lit("AI: a AI: b \n🧠 Stats: 3"))) == "a b"
    assert one(spark, X.model_file_name(F.lit("org/m:3b"))) == "org_m:3b"
    assert one(spark, X.model_file_name(F.lit("org/m:3b"), drop_size=True)) == "org_m"
    assert one(spark, X.truncated(F.lit("abcdef"), 3)) == "abc..."


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Files cut into splits of 200 bytes; blank lines count."""
    wanted = set()
    for name, n in (("a.json", 300), ("b.json", 90)):
        lines = ["" if k % 4 == 0 else f"bad {k}" if k % 4 == 1 else '{"Status": "Event", "ID": "%d"}' % k for k in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        wanted |= {(name, k + 1) for k in range(n) if k % 4 == 1}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rejects = S.read_alerts(spark, str(tmp_path)).rejects
        assert rejects.select("line_order.file", "line_order.block").distinct().count() > 20
        assert {(r.source_file.rsplit("/", 1)[1], r.line_num) for r in rejects.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
