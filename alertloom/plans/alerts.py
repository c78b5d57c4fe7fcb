"""Queries over alerts: reading, linking, grouping, reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import incidents as I
from alertloom.plans import inputs as N
from alertloom.sources import alerts as S


def _linked(spark, sf):
    return I.link_events(N.alert_links(spark, sf), N.alert_events(spark, sf))


def incident_groups(spark, sf):
    return I.incident_groups(_linked(spark, sf)).select(
        "incident_id", "severity", "target_summary", "events", "descriptions", "first_pos",
        "time_range", "severity_rank", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


def incident_desc_top3(spark, sf):
    return I.group_examples(I.description_counts(_linked(spark, sf))).select(
        "incident_id", "severity", "target_summary", "example", "description", "copies")


def severity_breakdown(spark, sf):
    return I.severity_breakdown(I.incident_groups(_linked(spark, sf)))


def incident_report(spark, sf):
    return I.incident_report(N.alert_incidents(spark, sf), _linked(spark, sf))


def pattern_groups(spark, sf):
    return I.pattern_groups(_linked(spark, sf)).drop("raw_chars").withColumn("samples", F.array_join("samples", ","))


def evidence_text(spark, sf):
    return I.evidence_text(I.pattern_groups(_linked(spark, sf)))


def raw_evidence_text(spark, sf):
    return I.raw_evidence_text(_linked(spark, sf))


def size_reduction(spark, sf):
    return I.size_reduction(I.pattern_groups(_linked(spark, sf))).withColumn(
        "saved_percent", F.round("saved_percent", 6))


def token_reduction(spark, sf):
    """What grouping saves in tokens, here words."""
    linked = _linked(spark, sf)
    words = lambda line: F.size(F.filter(F.split(line, " "), lambda w: w != ""))
    found = I.size_reduction(I.pattern_groups(linked), linked, words)
    return found.select("incident_id", "raw_tokens", F.round("saved_tokens_percent", 6).alias("saved_tokens_percent"))


def missing_events(spark, sf):
    return I.missing_events(N.alert_links(spark, sf), N.alert_events(spark, sf)) \
        .select("incident_id", "pos", "event_id")


def file_scoped_links(spark, sf):
    """Events count only if they lie in the file of their incident; every ninth lies elsewhere."""
    base = N.event_base(spark, sf)
    home = F.concat(F.lit("f"), (F.col("b") % 8).cast("string"))
    event_id = F.col("event_id").cast("string").alias("event_id")
    links = base.select(home.alias("source_file"), "incident_id", F.col("event_id").alias("pos"), event_id)
    events = base.select(
        F.when(F.col("k") % 9 == 0, F.lit("elsewhere")).otherwise(home).alias("source_file"), event_id)
    return I.link_counts(links, events, "file")


def source_summary(spark, sf):
    return I.source_summary(N.alert_events(spark, sf)).withColumn("hours", F.round("hours", 6))


def source_event_types(spark, sf):
    return I.source_event_types(N.alert_events(spark, sf))


def read_alerts(spark, sf):
    events = S.parse_lines(N.alert_lines(spark, sf)).events
    return events.select(
        "event_id", "severity", F.round("confidence", 6).alias("confidence"), "description",
        F.array_join("source_ips", ",").alias("source_ips"),
        F.array_join("target_ips", ",").alias("target_ips"),
        F.array_join(F.col("target_ports").cast("array<string>"), ",").alias("target_ports"),
        "start_time", F.col("note")["timewindow"].alias("timewindow"), "source_file")


def parse_counts(spark, sf):
    return S.parse_counts(S.parse_lines(N.alert_lines(spark, sf, spoiled=True)))


def last_event_wins(spark, sf):
    """Events that share an id because the user id serves as one."""
    events = N.event_base(spark, sf).select(
        F.col("user_id").cast("string").alias("event_id"), "event_type", "k",
        F.col("event_id").alias("line_order"))
    return S.last_events(events)


QUERIES = {f.__name__: f for f in (
    incident_groups, incident_desc_top3, severity_breakdown, incident_report, pattern_groups,
    evidence_text, raw_evidence_text, size_reduction, token_reduction, missing_events, file_scoped_links,
    source_summary, source_event_types, read_alerts, parse_counts, last_event_wins,
)}

EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, event_type, value, user_id, user_id % 30 AS b, (day(ts) - 1) // 6 AS w,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events),
raw AS (
  SELECT *, b || '-' || w AS incident_id, event_id * 2 AS pos,
         CASE event_type WHEN 'error' THEN 'High' WHEN 'purchase' THEN 'Medium'
              WHEN 'signup' THEN 'Low' WHEN 'click' THEN 'Info' ELSE 'Unknown' END AS severity,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS start_time,
         strftime(ts, '%H:%M') AS short,
         '192.168.0.' || (k % 3) AS ip,
         CASE k % 3 WHEN 0 THEN 53 WHEN 1 THEN 80 ELSE 443 END AS port
  FROM ev),
alert AS (
  SELECT *, CASE k % 4
      WHEN 0 THEN 'Connection to ' || ip || ':' || port
      WHEN 1 THEN 'Detected a horizontal port scan to port ' || port || '/TCP. ' || k || ' unique dst IPs'
      WHEN 2 THEN 'Connecting to private IP: ' || ip || ' on destination port: ' || port
      ELSE k || ' reconnection attempts' END AS description
  FROM raw),
ranked AS (
  SELECT *, CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1
                 WHEN 'Info' THEN 0 ELSE -1 END AS severity_rank,
         CASE WHEN k % 10 <> 0 AND k % 7 <> 0 THEN ip || ':' || port
              WHEN k % 10 <> 0 THEN ip
              WHEN k % 7 <> 0 THEN 'port ' || port
              ELSE split_part(description, ' ', 1) END AS target_summary
  FROM alert)
"""

PATTERNS_SQL = r"""
patterned AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(description,
      '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '<IP>', 'g'),
      '(?i)\b\d+/TCP\b', '<PORT>/TCP', 'g'), '(?i)\b\d+/UDP\b', '<PORT>/UDP', 'g'),
      '(?i)port[s]?:?\s*\d+(-\d+)?', 'port <PORT>', 'g'), '\b\d+\b', '<NUM>', 'g') AS pattern
  FROM ranked),
nth AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id, pattern ORDER BY start_time, pos) AS n
  FROM patterned),
vals AS (
  SELECT incident_id, pattern, n, u.i AS i, u.v AS v FROM (
    SELECT incident_id, pattern, n,
      list_concat(list_slice(regexp_extract_all(description, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'), 1, 2),
                  list_slice(regexp_extract_all(description, '(?i)\b\d+/(?:TCP|UDP)\b'), 1, 2)) AS vs
    FROM nth WHERE n <= 3) t, LATERAL (SELECT unnest(vs) AS v, generate_subscripts(vs, 1) AS i) u),
firsts AS (
  SELECT incident_id, pattern, v, min(n * 100 + i) AS seen FROM vals GROUP BY ALL),
samples AS (
  SELECT incident_id, pattern, string_agg(v, ',' ORDER BY seen) AS samples,
         string_agg(v, ', ' ORDER BY seen) AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, pattern ORDER BY seen) AS r FROM firsts)
  WHERE r <= 5 GROUP BY ALL),
pgroups AS (
  SELECT p.incident_id, p.pattern, count(*) AS events, min(pos) AS first_pos,
         CASE WHEN strftime(min(ts), '%H:%M') = strftime(max(ts), '%H:%M') THEN strftime(min(ts), '%H:%M')
              ELSE strftime(min(ts), '%H:%M') || '-' || strftime(max(ts), '%H:%M') END AS time_range,
         coalesce(any_value(samples), '') AS samples, any_value(shown) AS shown,
         arg_min(description, n) AS description
  FROM nth p LEFT JOIN samples s ON p.incident_id = s.incident_id AND p.pattern = s.pattern
  GROUP BY p.incident_id, p.pattern),
plines AS (
  SELECT *, CASE WHEN events = 1 THEN time_range || ' | ' || description
       ELSE time_range || ' | ' || description || ' (' || events || 'x similar, samples: '
            || coalesce(shown, 'various') || ')' END AS line
  FROM pgroups)
"""

GROUPS_SQL = """
descs AS (
  SELECT incident_id, severity, target_summary, description, count(*) AS copies, min(pos) AS first_pos,
         min(short) AS t0, max(short) AS t1, min(ts) AS first_at, any_value(severity_rank) AS severity_rank
  FROM ranked GROUP BY ALL),
groups AS (
  SELECT incident_id, severity, target_summary, CAST(sum(copies) AS BIGINT) AS events,
         count(*) AS descriptions, min(first_pos) AS first_pos,
         CASE WHEN min(t0) = max(t1) THEN min(t0) ELSE min(t0) || '-' || max(t1) END AS time_range,
         any_value(severity_rank) AS severity_rank,
         strftime(min(first_at), '%Y-%m-%d %H:%M:%S') AS first_at
  FROM descs GROUP BY incident_id, severity, target_summary),
examples AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY incident_id, severity, target_summary
                                 ORDER BY copies DESC, first_pos) AS example
    FROM descs) WHERE example <= 3),
breakdown AS (
  SELECT incident_id, CAST(sum(events) AS BIGINT) AS event_count,
         string_agg(severity || ': ' || events, ', ' ORDER BY severity_rank DESC, first_pos) AS breakdown
  FROM (SELECT incident_id, severity, any_value(severity_rank) AS severity_rank,
               CAST(sum(events) AS BIGINT) AS events, min(first_pos) AS first_pos
        FROM groups GROUP BY incident_id, severity)
  GROUP BY incident_id)
"""

ORACLES = {
    "incident_groups": f"WITH {EVENTS_SQL}, {GROUPS_SQL} SELECT * FROM groups",
    "incident_desc_top3": f"""WITH {EVENTS_SQL}, {GROUPS_SQL}
        SELECT incident_id, severity, target_summary, CAST(example AS INT) AS example, description, copies
        FROM examples""",
    "severity_breakdown": f"WITH {EVENTS_SQL}, {GROUPS_SQL} SELECT * FROM breakdown",
    "incident_report": f"""WITH {EVENTS_SQL}, {GROUPS_SQL},
        texts AS (
          SELECT incident_id, severity, target_summary, string_agg(
                   '  - ' || description || CASE WHEN copies > 1 THEN ' (x' || copies || ')' ELSE '' END,
                   chr(10) ORDER BY example) AS t
          FROM examples GROUP BY ALL),
        blocks AS (
          SELECT g.incident_id, string_agg(
              '• ' || time_range || ' - '
              || CASE WHEN events = 1 THEN 'Event to ' ELSE events || ' events to ' END || g.target_summary
              || ' [' || upper(g.severity) || ']' || chr(10) || t
              || CASE WHEN descriptions > 3
                      THEN chr(10) || '  - ... and ' || (descriptions - 3) || ' more variations' ELSE '' END,
              chr(10) ORDER BY severity_rank DESC, first_pos) AS body
          FROM groups g JOIN texts x ON g.incident_id = x.incident_id AND g.severity = x.severity
               AND g.target_summary = x.target_summary
          GROUP BY g.incident_id),
        inc AS (
          SELECT incident_id, '10.0.0.' || b AS source_ip, CAST(w AS VARCHAR) AS timewindow,
                 (CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // 100) / 100.0 AS threat_level,
                 strftime(min(ts), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S')
                   AS timeline
          FROM ranked GROUP BY incident_id, b, w)
        SELECT i.incident_id, source_ip, timewindow, timeline,
               CAST(threat_level AS DOUBLE) AS threat_level, event_count,
               repeat('=', 60) || chr(10) || 'Incident: ' || i.incident_id || chr(10)
               || 'Source IP: ' || source_ip || ' | Timewindow: ' || timewindow || chr(10)
               || 'Timeline: ' || timeline || chr(10)
               || 'Threat Level: ' || CAST(CAST(threat_level AS DOUBLE) AS VARCHAR) || ' | Events: '
               || event_count || chr(10) || chr(10) || body || chr(10) || chr(10)
               || 'Total Evidence: ' || event_count || ' events' || chr(10)
               || 'Severity breakdown: ' || breakdown AS analysis
        FROM inc i JOIN blocks USING (incident_id) JOIN breakdown USING (incident_id)""",
    "pattern_groups": f"""WITH {EVENTS_SQL}, {PATTERNS_SQL}
        SELECT incident_id, pattern, events, first_pos, time_range, samples, description FROM pgroups""",
    "evidence_text": f"""WITH {EVENTS_SQL}, {PATTERNS_SQL}
        SELECT incident_id, string_agg(line, chr(10) ORDER BY events DESC, time_range, first_pos)
               AS text, count(*) AS lines
        FROM plines GROUP BY incident_id""",
    "raw_evidence_text": f"""WITH {EVENTS_SQL}
        SELECT incident_id, string_agg(short || ' | ' || description, chr(10)
               ORDER BY pos) AS text, count(*) AS lines
        FROM alert GROUP BY incident_id""",
    "size_reduction": f"""WITH {EVENTS_SQL}, {PATTERNS_SQL},
        r AS (SELECT incident_id, count(*) AS events,
                     CAST(sum(length(short || ' | ' || description)) + count(*) - 1 AS BIGINT) AS raw_chars
              FROM alert GROUP BY incident_id),
        g AS (SELECT incident_id, count(*) AS patterns,
                     CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS grouped_chars
              FROM plines GROUP BY incident_id)
        SELECT incident_id, events, raw_chars, patterns, grouped_chars,
               round(100.0 * (1 - CAST(grouped_chars AS DOUBLE) / raw_chars), 6) AS saved_percent
        FROM r JOIN g USING (incident_id)""",
    "token_reduction": f"""WITH {EVENTS_SQL}, {PATTERNS_SQL},
        r AS (SELECT incident_id, CAST(sum(len(list_filter(string_split(short || ' | ' || description, ' '), lambda w: w <> ''))) AS BIGINT) AS raw_tokens
              FROM alert GROUP BY incident_id),
        g AS (SELECT incident_id, sum(len(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS n FROM plines GROUP BY incident_id)
        SELECT incident_id, raw_tokens, round(100.0 * (1 - CAST(n AS DOUBLE) / raw_tokens), 6) AS saved_tokens_percent FROM r JOIN g USING (incident_id)""",
    "missing_events": f"""WITH {EVENTS_SQL}
        SELECT incident_id, event_id * 2 + 1 AS pos, 'lost-' || event_id AS event_id
        FROM alert WHERE k % 20 = 0""",
    "file_scoped_links": f"""WITH {EVENTS_SQL}
        SELECT 'f' || (b % 8) AS source_file, incident_id, count(*) AS total_event_ids,
               count(*) FILTER (k % 9 <> 0) AS num_events, count(*) FILTER (k % 9 = 0) AS missing_events
        FROM alert GROUP BY ALL""",
    "source_summary": f"""WITH {EVENTS_SQL}
        SELECT '10.0.0.' || (user_id % 250) AS source_ip, count(*) AS events,
               count(DISTINCT CASE WHEN k % 10 <> 0 THEN ip END) AS unique_targets,
               count(DISTINCT severity) AS severities,
               round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) // 1000000 / 3600.0, 6) AS hours
        FROM alert GROUP BY 1""",
    "source_event_types": f"""WITH {EVENTS_SQL}, {PATTERNS_SQL}
        SELECT '10.0.0.' || (user_id % 250) AS source_ip, pattern AS event_type, count(*) AS events
        FROM patterned GROUP BY ALL""",
    "read_alerts": f"""WITH {EVENTS_SQL}
        SELECT CAST(event_id AS VARCHAR) AS event_id, severity, round(value / 500, 6) AS confidence,
               description, '10.0.0.' || (user_id % 250) AS source_ips,
               CASE WHEN k % 10 = 0 THEN '' ELSE ip END AS target_ips,
               CASE WHEN k % 7 = 0 THEN '' ELSE CAST(port AS VARCHAR) END AS target_ports, start_time,
               CAST(w AS VARCHAR) AS timewindow, 'f' || (b % 8) AS source_file
        FROM alert""",
    "parse_counts": f"""WITH {EVENTS_SQL}
        SELECT CASE WHEN k % 17 = 0 THEN 'bad json' WHEN k % 19 = 0 THEN 'bad record'
                    WHEN k % 23 = 0 THEN 'unknown status' ELSE 'event' END AS kind, count(*) AS lines
        FROM ev GROUP BY ALL""",
    "last_event_wins": f"""WITH {EVENTS_SQL}
        SELECT CAST(user_id AS VARCHAR) AS event_id, arg_max(event_type, ev.event_id) AS event_type,
               arg_max(k, ev.event_id) AS k, max(ev.event_id) AS line_order
        FROM ev GROUP BY user_id""",
}
