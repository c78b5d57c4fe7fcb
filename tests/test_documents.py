"""JSON documents cut into splits at any place, against the json module."""

import collections
import json
import os
import random

import pytest

from alertloom.sources import analyses as N
from alertloom.sources.documents import document_records, shift


def documents():
    draw = random.Random(3)
    rows = [{"incident_id": f"i{k}", "s": draw.choice(["a}b{", '"q\\"}', "[x],{", "\\", "é}"]), "n": {"d": [1, {"e": "}"}]},
             "l": [draw.choice(["{", "}", "]"])] * draw.randrange(3)} for k in range(90)]
    wrapped = {"total": 1, "other": [{"x": 1}, {"y": "}"}] * 20, "incidents": rows[:40], "after": [{"z": 1}] * 20}
    return {
        "array": (json.dumps(rows), rows), "wrapped": (json.dumps(wrapped, indent=1) + "\n", rows[:40]), "none": ("[]", []), "few": ('{"incidents":[]}', []),
        "mixed": (' [ 1, "x}", {"a":{}} ,[{"b":1}], null ]\n', [1, "x}", {"a": {}}, [{"b": 1}], None]), "other": ('{"nothing":[{"a":1}]}', None),
        "inner": ('{"a":{"incidents":[{"x":1}]},"incidents" : [{"k":"v}"}]}', [{"k": "v}"}]), "open": ('[{"a":1}', None), "empty": ("", None), "words": ('"nothing"', None)}


@pytest.mark.parametrize("size", [1 << 27, 1500])
def test_records_of_documents_cut_anywhere(spark, tmp_path, size):
    wanted = documents()
    for name, (text, _) in wanted.items():
        (tmp_path / name).write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records, seen = document_records(spark, [str(tmp_path)])
        got = collections.defaultdict(dict)
        for r in records.collect():
            own = got[os.path.basename(r.file)]
            assert r.pos not in own
            own[r.pos] = json.loads(r.raw)
        state = {os.path.basename(r.file): r for r in seen.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, (_, rows) in wanted.items():
        if rows is not None:
            assert got[name] == dict(enumerate(rows)) and state[name].whole and state[name].found, name
    assert not state["open"].whole and not state["other"].found and not state["words"].found and "empty" not in state


def test_a_shift_of_two_stretches_is_one_after_the_other():
    draw = random.Random(4)
    for _ in range(3000):
        text = "".join(draw.choices(['"', "\\\\", '\\"', "{", "}", "[", "]", ",", "a"], k=20))
        cut = draw.randrange(len(text))
        if text[:cut].endswith("\\") and not text[:cut].endswith("\\\\"):
            continue  # documents are cut behind braces only
        for inside in (False, True):
            middle, a = shift(text[:cut], inside)
            if text[cut - 1:cut] == "\\":
                continue
            end, b = shift(text[cut:], middle)
            assert shift(text, inside) == (end, a + b), (text, cut, inside)


def test_paths_keep_their_order(spark, tmp_path):
    (tmp_path / "dir").mkdir()
    for name, k in (("dir/one.json", 1), ("dir/two words.json", 2), ("b.json", 3)):
        (tmp_path / name).write_text(json.dumps([{"incident_id": str(k)}]))
    (tmp_path / "gone.json").write_text("{}")
    found = N.read_analyses(spark, [str(tmp_path / "b.json"), str(tmp_path / "dir"), str(tmp_path / "dir/o*.json"), str(tmp_path / "gone.json")])
    assert sorted((r.file_order, r.incident_id) for r in found.records.collect()) == [(0, "3"), (1, "1"), (1, "2"), (2, "1")]
    assert [r.file_order for r in found.rejects.collect()] == [3]


def test_files_of_a_merge_are_looked_at(spark, tmp_path):
    from alertloom.operators import datasets as D

    rows = [{"incident_id": k, "category": "Normal", "source_ip": "1", "timewindow": "1", "timeline": "t", "threat_level": 1.0, "event_count": 2} for k in "ab"]
    (tmp_path / "in.json").write_text(json.dumps({"incidents": rows}))
    (tmp_path / "bad.json").write_text('{"incidents": [')
    (tmp_path / "out.json").write_text(json.dumps(rows))
    good, bad, out = (str(tmp_path / n) for n in ("in.json", "bad.json", "out.json"))
    output = N.read_analyses(spark, [out], "array").records
    inputs = N.read_analyses(spark, [good, bad], "wrapped").records
    for paths, passed, detail in (([good], True, "0 unreadable"), ([good, bad], False, "1 unreadable"), ([good, bad, str(tmp_path / "gone.json")], False, "2 unreadable")):
        report = {r["check"]: r for r in D.verify_merge(inputs, output, N.unreadable_files(spark, paths, "wrapped")).collect()}
        assert (report["files"].passed, report["files"].detail, report["overall"].passed) == (passed, detail, passed)


def test_records_meet_their_files_without_a_shuffle_by_file(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"incident_id": f"i{k}"} for k in range(20)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = N.read_analyses(spark, [str(tmp_path)], "array").records
        plan = records._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.pos for r in records.select("pos").collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in top


def test_order_documents_sort_keys_alone(spark, tmp_path, monkeypatch):
    """The texts of a document's records are made behind the sort; duplicates, null keys and the edges of the documents stay."""
    from pyspark.sql import functions as F

    from alertloom.plans import inputs, roundtrips

    frame = type(spark.range(0))

    rows = [("a", "P", 3), ("b", "P", 1), ("a", "P", 3), (None, "O", 2), ("c", "F", None)]
    monkeypatch.setattr(inputs, "order_incidents", lambda *_: spark.createDataFrame(rows, "incident_id string, status string, event_count long"))
    sorted_columns, sort = [], frame.sortWithinPartitions
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda self, *a, **b: sorted_columns.append(self.columns) or sort(self, *a, **b))
    paths = roundtrips._order_documents(spark, None, False)
    assert sorted_columns == [["status", "part", "incident_id", "event_count"]]
    texts = [json.loads("".join(r.value for r in spark.read.text(p, wholetext=True).select(F.col("value")).collect())) for p in paths]
    assert [[(r.get("incident_id"), r.get("event_count")) for r in t] for t in texts] == [
        [("a", 3), ("a", 3), ("b", 1), ("last", None)], [(None, 2), ("last", None)], [("c", None), ("last", None)]]
