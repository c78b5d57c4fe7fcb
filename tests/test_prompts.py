import json

import pytest
from pyspark.sql import functions as F

from alertloom.functions import chat as C
from alertloom.operators import assertions as O
from alertloom.operators import conversations as V
from alertloom.operators import prompts as P
from alertloom.operators import sampling as S


def outputs(spark, *values):
    return spark.createDataFrame([("m", "s", "t", v) for v in values],
                                 "provider string, suite string, test string, output string")


SCHEMA = {"type": "object", "required": ["id.orig_h", "n"], "properties": {
    "id.orig_h": {"type": "string", "pattern": r"^10\.0\.0\.5$"}, "n": {"type": "number"},
    "inner": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "enum": ["x", "y"]}}}}}
FITTING = json.dumps({"id.orig_h": "10.0.0.5", "n": 1.5, "inner": {"k": "x"}})


@pytest.mark.parametrize("assertion, output, passed", [
    ({"type": "contains", "value": "a b"}, "xa by", True), ({"type": "contains", "value": "A"}, "a", False),
    ({"type": "icontains-all", "value": ["A", "b"]}, "xaB", True), ({"type": "icontains-all", "value": ["A", "c"]}, "ab", False),
    ({"type": "regex", "value": r"^s\d$"}, "s1", True), ({"type": "regex", "value": r"^s\d$"}, "xs1", False),
    ({"type": "is-json"}, "[1]", True), ({"type": "is-json"}, "{bad", False),
    ({"type": "is-json", "value": SCHEMA}, FITTING, True), ({"type": "is-json", "value": SCHEMA}, f"x {FITTING}", False),
    ({"type": "contains-json", "value": SCHEMA}, f"x {FITTING} y", True), ({"type": "contains-json", "value": SCHEMA}, "none", False),
    ({"type": "is-json", "value": SCHEMA}, FITTING.replace("1.5", '"1.5"'), False),
    ({"type": "is-json", "value": SCHEMA}, FITTING.replace("10.0.0.5", "10.0.0.55"), False),
    ({"type": "is-json", "value": SCHEMA}, FITTING.replace('"x"', '"z"'), False),
    ({"type": "is-json", "value": SCHEMA}, FITTING.replace('"k"', '"q"'), False),
    ({"type": "is-json", "value": SCHEMA}, '{"id.orig_h": "10.0.0.5"}', False),
    ({"type": "is-json", "value": SCHEMA}, '{"id.orig_h": "10.0.0.5", "n": 3}', True),
])
def test_assertions(spark, assertion, output, passed):
    checked = O.check_outputs(outputs(spark, output), [{"suite": "s", "test": "t", **assertion}]).collect()
    assert [r["passed"] for r in checked] == [passed]


def test_a_test_passes_if_all_its_assertions_do(spark):
    rules = [{"suite": "s", "test": "t", "type": "contains", "value": v} for v in ("a", "b")]
    rules.append({"suite": "s", "test": "other", "type": "contains", "value": "never"})
    rules.append({"suite": "s", "test": "t", "type": "llm-rubric", "value": "is nice"})
    both = outputs(spark, "ab").withColumn("verdict", F.lit(False))
    assert O.test_results(O.check_outputs(both, rules)).first()["passed"]
    assert not O.test_results(O.check_outputs(both, rules, "verdict")).first()["passed"]
    half = O.suite_results(O.test_results(O.check_outputs(outputs(spark, "a"), rules))).first()
    assert (half["passed"], half["failed"]) == (0, 1)


def test_model_failures_keep_or_drop_rows(spark):
    def model(prompt):
        if prompt == "2":
            raise RuntimeError("down")
        return f"AI: {prompt}"

    rows = spark.range(4).select(F.col("id").cast("string").alias("prompt"))
    kept = {r["prompt"]: (r["reply"], r["error"]) for r in
            P.apply_model(rows, "prompt", model, failure="failed: {error}").collect()}
    assert kept["1"] == ("AI: 1", None) and kept["2"] == ("failed: down", "down") and len(kept) == 4
    assert P.apply_model(rows, "prompt", model, "drop").count() == 3
    with pytest.raises(ValueError):
        P.apply_model(rows, "prompt", model, "retry")


def test_token_count(spark):
    rows = spark.createDataFrame([("a b c",), (None,), ("fail",)], "text string")

    def encode(text):
        if text == "fail":
            raise ValueError
        return text.split()

    assert [r[0] for r in rows.select(P.token_count(F.col("text"), encode)).collect()] == [3, 0, 0]
    assert rows.select(P.token_count(F.col("text"), None)).first()[0] == 0


def test_judge_replies(spark):
    reply = json.dumps({"rankings": {"1": "B", "2": "A", "3": "Q"}, "scores": {"A": 3, "B": 8.5, "Q": 1, "R": 2}})
    rows = spark.createDataFrame([(1, reply, {"A": "m1", "B": "m2"}), (2, "{}", {"A": "m1"}), (3, "no", {})],
                                 "n int, reply string, randomization map<string,string>")
    parsed = {r["n"]: r for r in P.judge_replies(rows, names={"m1": "One", "m2": "Two"}).collect()}
    assert parsed[1]["rankings"] == {"1": "Two", "2": "One", "3": "unknown"}
    assert parsed[1]["scores"] == {"One": 3.0, "Two": 8.5, "unknown": 2.0} and parsed[1]["justification"] == ""
    assert parsed[2]["rankings"] == {} and parsed[3]["scores"] == {}


def test_prompts_carry_their_parts(spark):
    incidents = spark.createDataFrame([("i", ["1.1.1.1"], "3", "7.5", "2024-01-01T10:00:00Z", "")],
                                      "incident_id string, source_ips array<string>, timewindow string, "
                                      "threat_level string, start_time string, end_time string")
    evidence = spark.createDataFrame([("i", 0, "{{source_ip}} stays")], "incident_id string, part int, text string")
    counts = spark.createDataFrame([("i", 9)], "incident_id string, event_count int")
    for kind in ("summary", "behavior", "cause", "risk"):
        prompt = P.incident_prompts(incidents, evidence, counts, kind).first()["prompt"]
        assert "{{source_ip}} stays" in prompt and "1.1.1.1" in prompt and "ongoing" in prompt and "events: 9" in prompt
    judged = S.label_shuffle(spark.createDataFrame([("i", "Malware")], "incident_id string, category string"), ["m1", "m2"], ["A", "B"])
    texts = judged.withColumns({"analyses": F.create_map(F.lit("m1"), F.lit("text of one")), "dag": F.lit(None).cast("string")})
    prompt = P.judge_prompts(texts, "dag").first()["prompt"]
    assert "text of one" in prompt and prompt.count("N/A") == 2 and "### A" in prompt and "Malware" in prompt


def test_signature_prompts(spark):
    grid = S.prompt_grid(spark.range(40), {"threat": ["t1", "t2"], "protocol": ["HTTP"], "complexity": ["c"],
                                           "context": ["x"], "requirement": ["r"]}, "id")
    rows = P.signature_prompts(grid, "the manual").collect()
    assert {r["threat"] for r in rows} == {"t1", "t2"} and all("the manual" in r["prompt"] for r in rows)
    sig = spark.createDataFrame([("signature a {}",)], "signature string")
    for strategy in ("broader", "stricter", "mixed"):
        assert P.STRATEGIES[strategy] in P.variation_prompts(sig, strategy, 3).first()["prompt"]
    assert P.STRATEGIES["mixed"] in P.variation_prompts(sig, "odd").first()["prompt"]


def test_sections(spark):
    risk = "**Risk Level:** High\n\n**Justification:** two\nlines\n\n**Business Impact:** some\n**Investigation Priority:** Low - x"
    cause = "**Possible Causes:**\n\n**1. Malicious Activity:**\n• a\n• b\n\n**Conclusion:** done"
    rows = spark.createDataFrame([(risk, cause)], "risk string, cause string")
    r = P.section_columns(P.section_columns(rows, "risk", P.RISK_HEADINGS), "cause", P.CAUSE_HEADINGS).first()
    assert (r["risk_level"], r["justification"], r["priority"], r["likelihood"]) == ("High", "two\nlines", "Low - x", None)
    assert (r["malicious"], r["legitimate"], r["conclusion"]) == ("• a\n• b", None, "done")


def test_chat_records(spark):
    rows = spark.createDataFrame([("do", "", "out"), ("do", "with", "out")], "i string, x string, o string")
    chats = rows.select(C.alpaca_chat(F.col("i"), F.col("x"), F.col("o")).alias("c")).collect()
    assert [chats[0]["c"][1]["content"], chats[1]["c"][1]["content"]] == ["do", "do\n\nwith"]
    assert [t["role"] for t in chats[0]["c"]] == ["system", "user", "assistant"]
    reasoning = rows.select(C.reasoning_chat(F.col("i"), F.col("o")).alias("c")).first()["c"]
    assert reasoning[0]["content"].endswith("step-by-step reasoning.")
    shared = spark.createDataFrame([([("human", "q"), ("gpt", "a"), (None, "x"), ("human", None)],)],
                                   "t array<struct<from:string,value:string>>")
    turns = shared.select(C.sharegpt_chat(F.col("t")).alias("c")).first()["c"]
    assert [tuple(t) for t in turns] == [("user", "q"), ("assistant", "a")]
    assert rows.select(C.transcript(C.alpaca_chat(F.col("i"), F.col("x"), F.col("o")))).first()[0].endswith(
        "User: do\nAssistant: out\nAssistant:")


def test_conversation_statistics(spark):
    chats = spark.createDataFrame(
        [(0, [("user", "a"), (None, "b")]), (1, []), (2, None), (3, [("user", "c")])],
        "pos int, conversation array<struct<role:string,content:string>>")
    assert tuple(V.conversation_stats(chats).first()) == (4, 3, 0.75, 2)
    assert {r["role"]: r["turns"] for r in V.role_distribution(chats).collect()} == {"user": 2, "unknown": 1}
    assert [r["pos"] for r in V.first_chats(chats).collect()] == [0]
