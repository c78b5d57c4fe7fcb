"""Readers of the smaller inputs and all writers."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from alertloom.functions import alerts as A
from alertloom.operators import incidents as I
from alertloom.schemas import SERVING_BENCHMARK
from alertloom.sinks import files as K
from alertloom.sources import alerts as S
from alertloom.sources import tables as B


def lines_of(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_csv_and_nested_json(spark, tmp_path):
    (tmp_path / "b.csv").write_text("model,quantization,disk_size_mb,ram_size_mb,tokens_per_second\nm,Q4,1.5,2,\n")
    row = B.read_csv(spark, str(tmp_path / "b.csv"), SERVING_BENCHMARK).first()
    assert (row["model"], row["disk_size_mb"], row["tokens_per_second"]) == ("m", 1.5, None)
    (tmp_path / "n.json").write_text(json.dumps([{"evalId": "e", "metrics": {"testPassCount": 3, "deep": {"x": 1}}}]))
    flat = B.read_flat_json(spark, str(tmp_path / "n.json"),
                            "evalId string, metrics struct<testPassCount:int,deep:struct<x:int>>")
    assert flat.columns == ["evalId", "metrics.testPassCount", "metrics.deep.x"] and tuple(flat.first()) == ("e", 3, 1)
    (tmp_path / "j.json").write_text(json.dumps([{"incident_id": "i", "rankings": {"1": "m"}, "scores": {"m": 7}}]))
    assert B.read_judge_results(spark, str(tmp_path / "j.json")).first()["scores"] == {"m": 7.0}


def test_series(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("Time,Temp,More\n0,40.5,x\n1,41,y\n")
    rows = B.read_series(spark, [str(tmp_path / "s1.csv")]).orderBy("x").collect()
    assert [tuple(r) for r in rows] == [("s1.csv", 0.0, 40.5), ("s1.csv", 1.0, 41.0)]
    (tmp_path / "thin.csv").write_text("Time\n0\n")
    with pytest.raises(ValueError):
        B.read_series(spark, str(tmp_path / "thin.csv"))


def test_chat_files(spark, tmp_path):
    turn = {"role": "user", "content": "q"}
    items = [{"conversation": [turn]}, {"messages": [turn, turn]}, {"instruction": "i", "output": "o"}, {"other": 1}]
    for name, document in (("bare", items), ("wrapped", {"data": items})):
        (tmp_path / name).write_text(json.dumps(document))
        chats = B.read_chats(spark, str(tmp_path / name)).orderBy("pos").collect()
        assert [len(r["conversation"]) for r in chats] == [1, 2, 2, 0]
        assert [t["role"] for t in chats[2]["conversation"]] == ["user", "assistant"]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.sig").write_text("\n signature a {\n}\n\n")
    (tmp_path / "b.sig").write_text(" \n\n")
    rows = B.read_signature_files(spark, str(tmp_path / "*.sig")).collect()
    assert [r["text"] for r in rows] == ["signature a {\n}"]
    (tmp_path / "ok.md").write_text(" manual ")
    (tmp_path / "large.md").write_text("x" * 60000)
    (tmp_path / "broken.md").write_bytes(b"\xff\xfe\xfa")
    assert [r["text"] for r in B.read_reference_documents(spark, str(tmp_path / "*.md")).collect()] == ["manual"]
    assert B.read_prompts(spark, str(tmp_path / "ok.md")).first()["prompt"] == " manual "


def test_usage_counters(spark):
    out = "  Prompt tokens:     12\n  Completion tokens: 40\n  Total tokens:      52\n  Time taken:        8.00 sec\n  Tokens per second: 5.00 TPS\n"
    rows = spark.createDataFrame([(out,), ("  Usage information not available.",)], "o string")
    got = rows.select(*[c.alias(n) for n, c in B.usage_counters(F.col("o")).items()]).collect()
    assert tuple(got[0]) == (12, 40, 52, 8.0, 5.0) and set(got[1]) == {None}
    speed = spark.range(1).select(A.tokens_per_second(F.lit(10), F.lit(0.0)), A.megabytes(F.lit(1572864)),
                                  A.megabytes(F.lit(None))).first()
    assert tuple(speed) == (0.0, 1.5, 0.0)


def test_sample_file(spark, tmp_path):
    lines = [
        {"Status": "Incident", "ID": "i1", "CorrelID": ["e2", "e1"]}, {"Status": "Incident", "ID": "i2", "CorrelID": ["e1"]},
        {"Status": "Incident", "ID": "i3", "CorrelID": ["e1"]},
        {"Status": "Event", "ID": "e1", "Description": "one"}, {"Status": "Event", "ID": "e2", "Description": "two"}]
    (tmp_path / "alerts.json").write_text("\n".join(json.dumps(x) for x in lines))
    alerts = S.read_alerts(spark, str(tmp_path / "alerts.json"))
    sample = alerts.incidents.where("incident_id <> 'i3'").withColumn("category", F.lit('Mal"ware'))
    rows = K.sample_rows(sample, I.explode_links(alerts.incidents, "file"), S.last_events(alerts.events, "file"))
    K.write_sample(rows, str(tmp_path / "out"))
    written = [json.loads(x) for x in lines_of(tmp_path / "out")]
    assert [x["ID"] for x in written] == ["i1", "e2", "e1", "i2", "e1"]
    assert written[0]["category"] == 'Mal"ware' and written[0]["CorrelID"] == ["e2", "e1"]
    assert S.read_alerts(spark, str(tmp_path / "out")).incidents.count() == 2


def test_a_category_of_the_incident_is_replaced(spark):
    raw = ['{"ID": "i", "category": "old", "Note": "{\\"category\\": 1}"}', '{"category":null, "ID":"i"}', '{"ID": "i"}', "{}",
           '{"ID": "1", "Target": {"category": "x"}}', '{"Target": [{"category": "x"}], "category": {"a": ["b", {}]}, "z": [1, 2]}', '{"category": [1, 2]}',
           '{"a": "category", "category" : {}}', '{"category": "category", "b": "}"}']
    sample = spark.createDataFrame([("f", f"i{n}", r, "a$1\\ \"b") for n, r in enumerate(raw)], "source_file string, incident_id string, raw_json string, category string")
    links = spark.createDataFrame([], "source_file string, incident_id string, pos int, event_id string")
    events = spark.createDataFrame([], "source_file string, event_id string, raw_json string")
    for line, old in zip([r["line"] for r in K.sample_rows(sample, links, events).orderBy("incident_id").collect()], raw):
        pairs = json.loads(line, object_pairs_hook=list)
        assert [k for k, _ in pairs].count("category") == 1 and json.loads(line) == {**json.loads(old), "category": 'a$1\\ "b'}


def test_tables_and_records(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, "x,y")], "incident_id string, n int, text string")
    K.write_table(df, str(tmp_path / "csv"), ["incident_id"], single=True)
    assert list(csv.reader(lines_of(tmp_path / "csv"))) == [["incident_id", "n", "text"], ["a", "1", "x,y"], ["b", "2", ""]]
    K.write_records(df, str(tmp_path / "json"), ["incident_id"])
    assert [json.loads(x)["incident_id"] for x in lines_of(tmp_path / "json")] == ["a", "b"]
    for rows in (df, df.limit(0), df.union(df)):
        for wrapped in (False, True):
            K.write_json_document(rows, str(tmp_path / "doc"), ["incident_id"], wrapped=wrapped)
            document = json.loads("\n".join(lines_of(tmp_path / "doc")))
            records = document["incidents"] if wrapped else document
            assert [r["n"] for r in records] == sorted(r["n"] for r in rows.collect())
            assert not wrapped or document["total_incidents"] == len(records)


def test_signature_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "signature a {\n}"), (2, "signature b {\n}")], "n int, signature string")
    K.write_signatures(df, str(tmp_path / "sig"), order=["n"], single=True)
    assert "\n".join(lines_of(tmp_path / "sig")) == "signature a {\n}\n\nsignature b {\n}\n"


def test_a_sample_keeps_its_order_and_is_read_back(spark, tmp_path):
    lines = [{"Status": "Incident", "ID": f"i{k}", "CorrelID": [f"e{k}", "e0"]} for k in range(6)] + [{"Status": "Event", "ID": f"e{k}"} for k in range(6)]
    (tmp_path / "alerts.json").write_text("\n".join(json.dumps(x) for x in lines))
    alerts = S.read_alerts(spark, str(tmp_path / "alerts.json"))
    order = F.when(F.col("incident_id") == "i4", 0).when(F.col("incident_id") == "i1", 1).when(F.col("incident_id") == "i3", 2)
    sample = alerts.incidents.withColumns({"sample_order": order, "category": F.lit("Normal")}).where("sample_order IS NOT NULL")
    rows = K.sample_rows(sample, I.explode_links(alerts.incidents, "file"), S.last_events(alerts.events, "file"))
    K.write_sample(rows, str(tmp_path / "out"))
    assert [json.loads(x)["ID"] for x in lines_of(tmp_path / "out")] == ["i4", "e4", "e0", "i1", "e1", "e0", "i3", "e3", "e0"]


def test_documents_end_once_though_rows_repeat(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x")] * 3 + [("b", "y" * 50_000)] * 2, "incident_id string, text string")
    K.write_json_document(rows, str(tmp_path / "doc"), ["incident_id"], wrapped=True)
    text = "".join(x + "\n" for x in lines_of(tmp_path / "doc"))
    assert [r["incident_id"] for r in json.loads(text)["incidents"]] == ["a", "a", "a", "b", "b"]


def test_series_files_of_different_widths(spark, tmp_path):
    from alertloom.sources.tables import read_series

    (tmp_path / "a.csv").write_text("Time,Temperature\n0.5,40\n1.5,41\n")
    (tmp_path / "b.csv").write_text("minutes,degrees,note\n2,7,\"x, y\"\n\n3,bad,z\n")
    assert sorted(tuple(r) for r in read_series(spark, str(tmp_path)).where("y IS NOT NULL").collect()) == [
        ("a.csv", 0.5, 40.0), ("a.csv", 1.5, 41.0), ("b.csv", 2.0, 7.0)]
    (tmp_path / "c.csv").write_text("only\n1\n")
    with pytest.raises(ValueError, match="c.csv"):
        read_series(spark, str(tmp_path))
