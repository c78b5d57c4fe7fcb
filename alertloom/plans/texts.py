"""Queries over signatures, feeds, assertions, prompts, replies, chats and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import alerts as A
from alertloom.functions import chat as C
from alertloom.functions import text as X
from alertloom.operators import assertions as O
from alertloom.operators import conversations as V
from alertloom.operators import evals as E
from alertloom.operators import feeds as W
from alertloom.operators import incidents as I
from alertloom.operators import prompts as P
from alertloom.operators import sampling as S
from alertloom.operators import series as R
from alertloom.operators import signatures as G
from alertloom.plans import inputs as N
from alertloom.plans.alerts import EVENTS_SQL, PATTERNS_SQL
from alertloom.plans.sampling import ORDERS_SQL


def normalised_documents(spark, sf):
    return N.table(spark, sf, "documents").select(
        "doc_id", F.md5(X.normalise_pattern(F.col("text"))).alias("pattern_md5"))


def signature_clean(spark, sf):
    return G.validate_signatures(N.signature_replies(spark, sf), "reply").select("event_id", "cleaned")


def signature_validate(spark, sf):
    return G.validate_signatures(N.signature_replies(spark, sf), "reply").select(
        "event_id", "valid", F.coalesce("reason", F.lit("")).alias("reason"))


def signature_parse(spark, sf):
    parsed = G.parse_signatures(N.signature_replies(spark, sf), "reply").where(F.col("parsed").isNotNull())
    p = F.col("parsed")
    return parsed.select(
        "event_id", p["name"].alias("name"),
        *[F.coalesce(F.try_element_at(p["fields"], F.lit(f))[0], F.lit("")).alias(f.replace("-", "_"))
          for f in ("ip-proto", "dst-port", "event")],
        F.array_join(F.transform(p["patterns"], lambda x: F.concat_ws(
            "/", x["type"], x["pattern"], x["flags"])), ";").alias("patterns"))


def signature_split(spark, sf):
    return G.split_replies(N.signature_replies(spark, sf), "reply").select("event_id", "index", "name")


def signature_accept(spark, sf):
    """The first valid ones among three times as many replies as are wanted."""
    replies = N.signature_replies(spark, sf).withColumn("attempt", F.col("event_id") + 1)
    return S.accept_first(G.validate_signatures(replies, "reply"), 200).select("attempt", "shortfall")


SIGNATURES = """signature any-tcp { ip-proto == tcp event "tcp" }
signature lan-errors { src-ip == 10.0.0.0/16, 10.2.0.0/15 dst-port == 80, 443
 payload /ERROR [0-9]+/ event "error" }
signature anywhere { ip-proto == udp
 payload /.*7$/
 dst-ip == 192.168.0.1
 event "seven" }
signature any-case { payload /purchase/i event "bought" }
signature not-at-start { payload /lick/ event "never" }"""


def _signature_table(spark):
    from pyspark.sql import Row
    blocks = SIGNATURES.replace(" src-ip", "\n src-ip").replace(" dst-port", "\n dst-port") \
        .replace(" event", "\n event").split("signature ")[1:]
    rows = spark.createDataFrame([Row(text="signature " + b) for b in blocks])
    return G.parse_signatures(rows, "text")


def signature_match(spark, sf):
    return G.match_signatures(N.flows(spark, sf), _signature_table(spark)).select(
        "event_id", "signature", "message")


def signature_hits(spark, sf):
    return G.signature_hits(G.match_signatures(N.flows(spark, sf), _signature_table(spark)))


FEED = [
    (r"^http://m[.]", "mobile without encryption"),
    (r"/(de|es)/\d+", "German or Spanish"),
    (r"pills|casino", "shop"),
    (r"utm_\w+=feed$", "came by a feed"),
    (r"[.]org/[a-z]{2}/\d*7\b", "ends in seven"),
    (r"#top$", "to the top"),
    (r"unclosed[", "no pattern"),
]


def _feed(spark, rows):
    return spark.createDataFrame(rows, "regex string, description string")


def uri_feed_match(spark, sf):
    pages = N.table(spark, sf, "pages").select("page_id", "url")
    return W.match_feed(pages, _feed(spark, FEED), "url")


def uri_feed_large(spark, sf):
    """A feed with a pattern for each page, all met by their literals."""
    pages = N.table(spark, sf, "pages").select("page_id", "url")
    path = F.regexp_extract("url", r"^https?://[^/]+(/[a-z]+/[0-9]+)", 1)
    feed = pages.where(path != "").select(F.concat(path, F.lit("($|[^0-9])")).alias("regex"), F.col("page_id").cast("string").alias("description"))
    return W.match_feed(pages, feed, "url").select("page_id", "regex")


def _page_feed(spark, sf, older: bool):
    """Two versions of a feed made from the pages: one per page, described by part of its address."""
    pages = N.table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    kept = pages.where(~F.col("url").startswith("http://blog")) if older else \
        pages.where(~F.col("url").contains("#"))
    described = F.when(F.col("url").contains("?"), F.lit("old")).otherwise(path) if older else path
    return kept.select(F.concat_ws(" ", "page_id", "url").alias("regex"), described.alias("description"))


def feed_changes(spark, sf):
    return W.feed_changes(_page_feed(spark, sf, True), _page_feed(spark, sf, False))


def _checked(spark, sf):
    return O.check_outputs(N.test_outputs(spark, sf), N.ASSERTIONS)


def assertions(spark, sf):
    return _checked(spark, sf).select("run", "assertion", "type", "passed")


def assertion_suites(spark, sf):
    """Runs as tests: each passes if all its assertions do; then pass rates."""
    runs = _checked(spark, sf).withColumn("test", F.col("run"))
    results = O.suite_results(O.test_results(runs))
    return E.pass_rate(results)


def prompt_fill(spark, sf):
    template = F.lit("Ask {{action}} about {{host}}; {{action}}.")
    variables = F.map_from_arrays(F.array(F.lit("action"), F.lit("host")), F.array(
        F.col("event_type"), F.concat(F.lit("10.0.0."), F.col("k").cast("string"))))
    tests = N.event_base(spark, sf).select("event_id", O.filled_prompt(template, variables).alias("prompt"))
    return O.provider_tests(tests, ["small", "large"])


def incident_prompts(spark, sf):
    linked = I.link_events(N.alert_links(spark, sf), N.alert_events(spark, sf))
    counts = linked.groupBy("incident_id").agg(F.count(F.lit(1)).alias("event_count"))
    template = "{{incident_id}} {{source_ip}} {{threat_text}} {{started}} {{until}} {{event_count}}\n{{evidence}}"
    return P.incident_prompts(N.alert_incidents(spark, sf), I.raw_evidence_text(linked), counts,
                              "summary", template)


def judge_prompts(spark, sf):
    shown = S.label_shuffle(N.order_incidents(spark, sf), ["alpha", "beta"], ["A", "B"])
    texts = F.create_map(F.lit("alpha"), F.concat(F.lit("by alpha "), "incident_id"))
    rows = shown.withColumns({"analyses": texts, "report": F.col("severity")})
    template = "{{labels}} {{category}}\n{{candidates}}\n{{evidence}}"
    return P.judge_prompts(rows, "report", template=template).select("incident_id", "prompt")


def _stub_model(prompt: str) -> str:
    if "Medium" in prompt:
        raise ValueError("no answer")
    return f"AI: {len(prompt)} characters"


def apply_model(spark, sf):
    asked = N.alert_events(spark, sf).select(
        "event_id", F.concat_ws(" ", "severity", "description").alias("prompt"))
    answered = P.apply_model(asked, "prompt", _stub_model, failure="LLM query failed - {error}")
    return answered.select("event_id", X.clean_reply(F.col("reply")).alias("reply"),
                           F.coalesce("error", F.lit("")).alias("error"))


def token_count(spark, sf):
    return N.table(spark, sf, "benchmark").select(
        "item_id", P.token_count(F.col("text"), str.split).alias("tokens"))


def response_cleanup(spark, sf):
    reply = F.concat(F.lit("AI: "), "text", F.when(F.col("role") == "user", F.lit("\n🧠 Stats: 5 tokens AI: 3"))
                     .otherwise(F.lit(" \n")))
    return N.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.clean_reply(reply).alias("reply"))


def judge_reply_parse(spark, sf):
    shown = S.label_shuffle(N.judge_replies(spark, sf), list(N.MODELS), ["A", "B", "C", "D"])
    parsed = P.judge_replies(shown)
    return parsed.select(
        "incident_id", "justification",
        *[F.coalesce(F.try_element_at("rankings", F.lit(str(p))), F.lit("")).alias(f"rank_{p}") for p in (1, 2, 3)],
        *[F.try_element_at("scores", F.lit(m)).alias(f"{m}_score") for m in N.MODELS])


def risk_sections(spark, sf):
    level = F.coalesce("severity", F.lit("Info"))
    reply = F.concat(F.lit("**Risk Level:** "), level, F.lit("\n\n**Justification:** because of\n"), "incident_id",
                     F.lit("\n\n**Investigation Priority:** High - soon\n"))
    rows = N.order_incidents(spark, sf).select("incident_id", reply.alias("reply"))
    return P.section_columns(rows, "reply", P.RISK_HEADINGS).select(
        "incident_id", *[F.coalesce(c, F.lit("")).alias(c) for c in P.RISK_HEADINGS])


def usage_stats(spark, sf):
    """Counters out of printed lines, and tokens per second worked out anew."""
    from alertloom.sources.tables import usage_counters
    printed = F.concat(F.lit("  Prompt tokens:     "), F.col("turn").cast("string"),
                       F.lit("\n  Completion tokens: "), F.length("text").cast("string"),
                       F.when(F.col("role") == "user", F.lit("\n  Time taken:        2.50 sec")).otherwise(""))
    rows = N.table(spark, sf, "conversations").select("conv_id", "turn", *[
        c.alias(n) for n, c in usage_counters(printed).items()])
    speed = A.tokens_per_second(F.col("completion_tokens"), F.col("seconds"))
    return rows.select("conv_id", "turn", "prompt_tokens", "completion_tokens", "seconds",
                       F.round(speed, 6).alias("tokens_per_second"),
                       A.megabytes(F.col("completion_tokens") * 10000).alias("megabytes"))


def conversation_stats(spark, sf):
    return V.turn_stats(N.table(spark, sf, "conversations")).withColumn("avg_turns", F.round("avg_turns", 6))


def role_distribution(spark, sf):
    return V.turn_roles(N.table(spark, sf, "conversations"))


def chat_render(spark, sf):
    return V.transcripts(N.table(spark, sf, "conversations"))


def chat_records(spark, sf):
    """Instruction records from the benchmark texts as rendered chats."""
    extra = F.when(F.col("item_id") % 2 == 0, F.lit("")).otherwise(F.lit("more"))
    chats = N.table(spark, sf, "benchmark").select(
        "item_id", C.alpaca_chat(F.lit("Repeat"), extra, F.col("text")).alias("conversation"))
    return chats.select("item_id", C.transcript(F.col("conversation")).alias("transcript"),
                        F.array_size("conversation").alias("turns"))


def series_elapsed(spark, sf):
    readings = N.table(spark, sf, "events").select(
        F.col("event_type").alias("series"), "event_id", "ts", "value")
    return R.elapsed(readings, "series", "ts").select(
        "series", "event_id", "minutes", "value")


QUERIES = {f.__name__: f for f in (
    normalised_documents, signature_clean, signature_validate, signature_parse, signature_split,
    signature_accept, signature_match, signature_hits, uri_feed_match, uri_feed_large, feed_changes, assertions,
    assertion_suites, prompt_fill, incident_prompts, judge_prompts, apply_model, token_count,
    response_cleanup, judge_reply_parse, risk_sections, usage_stats, conversation_stats,
    role_distribution, chat_render, chat_records, series_elapsed,
)}

# What the replies hold is known from how they were made; cleaning is done once more by regex.
REPLY_SQL = f"""{EVENTS_SQL},
body AS (
  SELECT event_id, event_type, k,
         '-' || event_id || ' {{' || chr(10) || '  ip-proto == tcp' || chr(10) || chr(10) || '  dst-port == '
         || (k + 1) || chr(10) || '  payload /GET .*' || k || '/i' || chr(10) || '  event "seen ' || event_type
         || '"' || chr(10) || '}}' AS rest FROM ev),
reply AS (
  SELECT event_id, event_type, k, CASE k % 8
      WHEN 0 THEN '```plaintext' || chr(10) || 'signature fenced' || rest || chr(10) || '```'
      WHEN 1 THEN 'rule x {{ condition = ' || event_id || ' }}'
      WHEN 2 THEN 'signature open' || rest || chr(10) || '{{'
      WHEN 3 THEN 'signature {{' || chr(10) || ' ip-proto == udp' || chr(10) || '}}' || chr(10) || event_id
      WHEN 4 THEN 'Here you are:' || chr(10) || chr(10) || 'signature first' || rest || chr(10) || chr(10)
                  || 'signature second' || rest
      WHEN 5 THEN 'signature bare-' || event_id || ' {{' || chr(10) || ' nothing' || chr(10) || '}}'
      WHEN 6 THEN ' ' || chr(10) || ' '
      ELSE 'signature plain' || rest END AS reply FROM body),
fault AS (
  SELECT *, CASE k % 8 WHEN 1 THEN 'other rule language' WHEN 2 THEN 'unbalanced braces' WHEN 3 THEN 'bad name'
       WHEN 4 THEN 'no signature keyword' WHEN 5 THEN 'no known field' WHEN 6 THEN 'empty' ELSE '' END AS reason
  FROM reply)
"""

FLOW_SQL = f"""{EVENTS_SQL},
flow AS (
  SELECT event_id, k, user_id % 7 AS net, upper(event_type) || ' ' || k AS payload,
         CASE k % 3 WHEN 0 THEN 53 WHEN 1 THEN 80 ELSE 443 END AS dst_port FROM ev),
hits AS (
  SELECT event_id, 'any-tcp' AS signature, 'tcp' AS message FROM flow WHERE k % 2 = 0
  UNION ALL SELECT event_id, 'lan-errors', 'error' FROM flow
            WHERE net IN (0, 2, 3) AND dst_port IN (80, 443) AND regexp_matches(payload, '^(?:ERROR [0-9]+)')
  UNION ALL SELECT event_id, 'anywhere', 'seven' FROM flow
            WHERE k % 2 = 1 AND k % 3 = 1 AND regexp_matches(payload, '^(?:.*7$)')
  UNION ALL SELECT event_id, 'any-case', 'bought' FROM flow WHERE regexp_matches(payload, '(?i)^(?:purchase)'))
"""

ASSERT_SQL = f"""{EVENTS_SQL},
o AS (
  SELECT event_id AS run, 'model-' || user_id AS provider, CASE WHEN w < 2 THEN 'format' ELSE 'content' END AS suite,
         k, event_type, '{{"action": "' || event_type || '", "parameters": {{"host": "10.0.0.' || k || '", "port": ' || k
         || '}}}}' AS doc FROM ev),
t AS (
  SELECT *, CASE k % 4 WHEN 0 THEN doc WHEN 1 THEN 'Sure: ' || doc || ' done'
              WHEN 2 THEN '{{"action": "' || event_type || '"}}' ELSE 'no document' END AS output FROM o),
js AS (
  SELECT *, regexp_extract(output, '(?s)\\{{.*\\}}') AS inner_text FROM t),
a AS (
  SELECT run, provider, suite, 0 AS assertion, 'is-json' AS type, json_valid(output)
         AND coalesce(json_extract_string(CASE WHEN json_valid(output) THEN output END, '$.action') IN ('click', 'view', 'error')
           AND json_extract_string(CASE WHEN json_valid(output) THEN output END, '$.parameters.host') IS NOT NULL, false) AS passed
  FROM js WHERE suite = 'format'
  UNION ALL SELECT run, provider, suite, 1, 'contains-json',
         coalesce(regexp_matches(json_extract_string(CASE WHEN json_valid(inner_text) THEN inner_text END, '$.parameters.host'),
                        '^10\\.0\\.0\\.[1-4]'), false) FROM js WHERE suite = 'format'
  UNION ALL SELECT run, provider, suite, 2, 'contains', contains(output, 'action') FROM js WHERE suite = 'content'
  UNION ALL SELECT run, provider, suite, 3, 'icontains-all',
         contains(lower(output), 'action') AND contains(lower(output), 'host') FROM js WHERE suite = 'content'
  UNION ALL SELECT run, provider, suite, 4, 'regex', regexp_matches(output, 'host": "10\\.0\\.0\\.\\d\\d')
  FROM js WHERE suite = 'content')
"""

LABEL_SQL = f"""{ORDERS_SQL},
m AS (
  SELECT incident_id, u.m AS model, chr(CAST(64 + row_number() OVER (
           PARTITION BY incident_id ORDER BY md5('0|' || incident_id || '|' || u.m)) AS INT)) AS label
  FROM inc, (SELECT unnest({list(N.MODELS)!r}) AS m) u),
r AS (
  SELECT incident_id, pos, status, ['A', 'B', 'C', 'D'][1 + pos % 4] AS a, ['A', 'B', 'C', 'D'][1 + (pos + 1) % 4] AS b
  FROM inc),
p AS (
  SELECT r.*, x.model AS ma, y.model AS mb FROM r
  JOIN m x ON r.incident_id = x.incident_id AND r.a = x.label
  JOIN m y ON r.incident_id = y.incident_id AND r.b = y.label)
"""


def _feed_sql() -> str:
    parts = []
    for regex, description in FEED[:-1]:
        literal = regex.replace("'", "''")
        parts.append(f"SELECT page_id, url, '{literal}' AS regex, '{description}' AS description "
                     f"FROM pages WHERE regexp_matches(url, '{literal}')")
    return " UNION ALL ".join(parts)


ORACLES = {
    "normalised_documents": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '<IP>', 'g'),
        '(?i)\b\d+/TCP\b', '<PORT>/TCP', 'g'), '(?i)\b\d+/UDP\b', '<PORT>/UDP', 'g'),
        '(?i)port[s]?:?\s*\d+(-\d+)?', 'port <PORT>', 'g'), '\b\d+\b', '<NUM>', 'g')) AS pattern_md5
        FROM documents""",
    "signature_clean": rf"""WITH {REPLY_SQL}
        SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(reply, '```\w*\n?', '', 'g'), '```', '', 'g'),
            '[ \t]*\n[ \t\n]*', chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS cleaned FROM reply""",
    "signature_validate": f"WITH {REPLY_SQL} SELECT event_id, reason = '' AS valid, reason FROM fault",
    "signature_parse": f"""WITH {REPLY_SQL}
        SELECT event_id, CASE k % 8 WHEN 0 THEN 'fenced' WHEN 2 THEN 'open' WHEN 4 THEN 'first' WHEN 5 THEN 'bare'
                              ELSE 'plain' END || '-' || event_id AS name,
               CASE WHEN k % 8 = 5 THEN '' ELSE 'tcp' END AS ip_proto,
               CASE WHEN k % 8 = 5 THEN '' ELSE CAST(k + 1 AS VARCHAR) END AS dst_port,
               CASE WHEN k % 8 = 5 THEN '' ELSE 'seen ' || event_type END AS event,
               CASE WHEN k % 8 = 5 THEN '' ELSE 'payload/GET .*' || k || '/i' END AS patterns
        FROM reply WHERE k % 8 IN (0, 2, 4, 5, 7) AND k % 8 <> 0
        UNION ALL SELECT event_id, 'fenced-' || event_id, 'tcp', CAST(k + 1 AS VARCHAR), 'seen ' || event_type,
               'payload/GET .*' || k || '/i' FROM reply WHERE k % 8 = 0""",
    "signature_split": f"""WITH {REPLY_SQL}
        SELECT event_id, 1 AS "index", 'first-' || event_id AS name FROM reply WHERE k % 8 = 4
        UNION ALL SELECT event_id, 2, 'second-' || event_id FROM reply WHERE k % 8 = 4
        UNION ALL SELECT event_id, 1, 'fenced-' || event_id FROM reply WHERE k % 8 = 0
        UNION ALL SELECT event_id, 1, 'bare-' || event_id FROM reply WHERE k % 8 = 5
        UNION ALL SELECT event_id, 1, 'plain-' || event_id FROM reply WHERE k % 8 = 7""",
    "signature_accept": f"""WITH {REPLY_SQL},
        v AS (SELECT event_id + 1 AS attempt FROM fault WHERE reason = '' AND event_id + 1 <= 600
              ORDER BY event_id LIMIT 200)
        SELECT attempt, 200 - (SELECT count(*) FROM v) AS shortfall FROM v""",
    "signature_match": f"WITH {FLOW_SQL} SELECT event_id, signature, message FROM hits",
    "signature_hits": f"WITH {FLOW_SQL} SELECT signature, count(*) AS matches FROM hits GROUP BY signature",
    "uri_feed_match": _feed_sql(),
    "uri_feed_large": r"""WITH
        u AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/[a-z]+/[0-9]+)', 1) AS path FROM pages),
        f AS (SELECT DISTINCT path, path || '($|[^0-9])' AS regex FROM u WHERE path <> '')
        SELECT page_id, regex FROM u JOIN f ON contains(u.url, f.path) AND regexp_matches(u.url, f.regex)""",
    "feed_changes": r"""WITH
        p AS (SELECT page_id || ' ' || url AS regex, url, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS path FROM pages),
        o AS (SELECT regex, CASE WHEN contains(url, '?') THEN 'old' ELSE path END AS d FROM p WHERE NOT starts_with(url, 'http://blog')),
        n AS (SELECT regex, path AS d FROM p WHERE NOT contains(url, '#'))
        SELECT regex, coalesce(n.d, o.d) AS description,
               CASE WHEN o.d IS NULL THEN 'NEW' WHEN n.d IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
        FROM o FULL OUTER JOIN n USING (regex) WHERE o.d IS NULL OR n.d IS NULL OR o.d <> n.d""",
    "assertions": f"WITH {ASSERT_SQL} SELECT run, assertion, type, passed FROM a",
    "assertion_suites": f"""WITH {ASSERT_SQL},
        x AS (SELECT provider, suite, run, bool_and(passed) AS passed FROM a GROUP BY ALL)
        SELECT provider, suite, count(*) FILTER (passed) AS total_pass, count(*) FILTER (NOT passed) AS total_fail,
               round(100.0 * count(*) FILTER (passed) / count(*), 2) AS pass_rate FROM x GROUP BY ALL""",
    "prompt_fill": f"""WITH {EVENTS_SQL}
        SELECT event_id, provider, 'Ask ' || event_type || ' about 10.0.0.' || k || '; ' || event_type || '.' AS prompt
        FROM ev, (SELECT unnest(['small', 'large']) AS provider) p""",
    "incident_prompts": f"""WITH {EVENTS_SQL},
        h AS (
          SELECT incident_id, incident_id || ' 10.0.0.' || b || ' '
                 || CAST(CAST((CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // 100) / 100.0 AS DOUBLE) AS VARCHAR)
                 || ' ' || strftime(min(ts), '%Y-%m-%d %H:%M:%S') || ' ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S')
                 || ' ' || count(*) AS head
          FROM alert GROUP BY incident_id, b)
        SELECT incident_id, any_value(head) || chr(10)
               || string_agg(short || ' | ' || description, chr(10) ORDER BY pos) AS prompt
        FROM alert JOIN h USING (incident_id) GROUP BY incident_id""",
    "judge_prompts": f"""WITH {ORDERS_SQL},
        x AS (SELECT *, md5('0|' || incident_id || '|alpha') < md5('0|' || incident_id || '|beta') AS alpha_first FROM inc)
        SELECT incident_id, 'A, B ' || category || chr(10) || '### A' || chr(10)
               || CASE WHEN alpha_first THEN 'by alpha ' || incident_id ELSE 'N/A' END || chr(10) || chr(10)
               || '### B' || chr(10) || CASE WHEN alpha_first THEN 'N/A' ELSE 'by alpha ' || incident_id END
               || chr(10) || coalesce(severity, 'N/A') AS prompt FROM x""",
    "apply_model": f"""WITH {EVENTS_SQL}
        SELECT CAST(event_id AS VARCHAR) AS event_id,
               CASE WHEN severity = 'Medium' THEN 'LLM query failed - no answer'
                    ELSE length(severity || ' ' || description) || ' characters' END AS reply,
               CASE WHEN severity = 'Medium' THEN 'no answer' ELSE '' END AS error FROM alert""",
    "token_count": r"""SELECT item_id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS tokens
        FROM benchmark""",
    "response_cleanup": r"""SELECT conv_id, turn,
        regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS reply FROM conversations""",
    "judge_reply_parse": f"""WITH {LABEL_SQL}
        SELECT incident_id, CASE WHEN status = 'P' THEN '' ELSE 'because ' || pos END AS justification,
               CASE WHEN status = 'P' THEN '' ELSE ma END AS rank_1, CASE WHEN status = 'P' THEN '' ELSE mb END AS rank_2,
               CASE WHEN status = 'P' THEN '' ELSE 'unknown' END AS rank_3,
               {', '.join(f"CASE WHEN status = 'P' THEN NULL WHEN ma = '{m}' THEN CAST(pos % 10 AS DOUBLE) WHEN mb = '{m}' THEN CAST(2.5 AS DOUBLE) END AS {m}_score" for m in N.MODELS)}
        FROM p""",
    "risk_sections": f"""WITH {ORDERS_SQL}
        SELECT incident_id, coalesce(severity, 'Info') AS risk_level, 'because of' || chr(10) || incident_id AS justification,
               '' AS business_impact, '' AS likelihood, 'High - soon' AS priority FROM inc""",
    "usage_stats": """SELECT conv_id, turn, turn AS prompt_tokens, length(text) AS completion_tokens,
               CASE WHEN role = 'user' THEN CAST(2.5 AS DOUBLE) END AS seconds,
               CASE WHEN role = 'user' THEN round(length(text) / CAST(2.5 AS DOUBLE), 6) ELSE 0.0 END AS tokens_per_second,
               round(length(text) * 10000 / CAST(1048576.0 AS DOUBLE), 1) AS megabytes FROM conversations""",
    "conversation_stats": """SELECT count(*) AS total_samples, CAST(sum(n) AS BIGINT) AS total_turns,
        round(avg(n), 6) AS avg_turns, CAST(0 AS BIGINT) AS empty_conversations
        FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)""",
    "role_distribution": "SELECT coalesce(role, 'unknown') AS role, count(*) AS turns FROM conversations GROUP BY 1",
    "chat_render": """SELECT conv_id, string_agg(
               CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn)
               || chr(10) || 'Assistant:' AS text, count(*) + 1 AS lines FROM conversations GROUP BY conv_id""",
    "chat_records": """SELECT item_id, 'Assistant: You are a helpful assistant.' || chr(10) || 'User: Repeat'
               || CASE WHEN item_id % 2 = 0 THEN '' ELSE chr(10) || chr(10) || 'more' END || chr(10)
               || 'Assistant: ' || text || chr(10) || 'Assistant:' AS transcript, 3 AS turns FROM benchmark""",
    "series_elapsed": """SELECT event_type AS series, event_id, value,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / CAST(60000000.0 AS DOUBLE) AS minutes
        FROM events""",
}
