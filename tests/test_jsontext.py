"""Strict JSON and the objects inside texts, against the json module."""

import json
import random
import time

import pytest

from alertloom.functions.jsontext import is_json, json_objects, objects_in
from alertloom.sources.alerts import parse_lines

TEXTS = ['{"a":1}', "{'a':1}", '{"a":"x\ty"}', "[1,2]", "1", "1 2", '"x"', "", "  ", "null", '{"a":NaN}', '{"a":1} x', '{"a":1},{"b":2}',
         "[1],[2]", '{"a":01}', '{"a":1,}', "{,}", "nul", '{"a":{"b":[1,{}]}}', '{"a":1', '"\\q"', None, "-Infinity", "tru", "true ", " {} "]


def sound(text):
    try:
        json.loads(text)
    except (TypeError, ValueError):
        return False
    return True


def brute_objects(text):
    found, at = [], 0
    while at < len(text):
        if text[at] == "{":
            try:
                end = json.JSONDecoder().raw_decode(text, at)[1]
                found.append(text[at:end])
                at = end
                continue
            except ValueError:
                pass
        at += 1
    return found


def test_is_json_is_strict(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", is_json(df.t).alias("j")).collect():
        assert r.j == sound(r.t), r.t


def test_objects_equal_trying_every_brace():
    rng = random.Random(1)
    parts = ["{", "}", '"', "[", "]", ":", ",", "1", "a", '{"a":1}', '"x":', "\\", '{"b":', '{"":{', "true", " ", "\n", '\\"', '":{', '{"k":"v"}']
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert objects_in(text) == brute_objects(text), text


@pytest.mark.parametrize("part", ['{"a":', "{", '":{', '{":', '{"a": "', '{"a":1} and ', '{"":"{",', '":{",":{":'])
def test_time_grows_with_the_length(part):
    def seconds(n):
        began = time.process_time()
        objects_in('{"' + part * n)
        return time.process_time() - began

    seconds(10_000)
    assert seconds(80_000) < 30 * max(seconds(10_000), 0.01)


def test_objects_in_a_column(spark):
    rows = [(None,), ("",), ('a {"b": {"c": "}"}} d {"e": 1',), ("é {} ü {'x': 1} {\"y\": \"ä\"}",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(json_objects("t")).collect()]
    assert got == [[], [], ['{"b": {"c": "}"}}'], ["{}", '{"y": "ä"}']]


def test_alert_lines_are_strict_and_parsed_to_their_end(spark):
    lines = ['{"Status": "Event", "ID": "1"}', "{'Status': 'Event', 'ID': '2'}", '{"Status": "Event", "ID": "3\t"}', '{"Status": "Event"} {"ID": "4"}',
             '{"Status": "Event", "ID": "5"}}', "{}", "[1]", '{"Status": "Event", "Source": "text"}', '{"Status": "Event", "ID": "9",}', "{ }"]
    df = spark.createDataFrame([(t, "f", i) for i, t in enumerate(lines)], "line string, source_file string, line_order long")
    alerts = parse_lines(df)
    assert [r.event_id for r in alerts.events.collect()] == ["1"]
    reasons = {r.line_order: r.reason for r in alerts.rejects.collect()}
    assert reasons == {1: "bad json", 2: "bad json", 3: "bad json", 4: "bad json", 5: "unknown status", 6: "bad record", 7: "bad record",
                       8: "bad json", 9: "unknown status"}


def test_objects_of_texts_of_any_tokens():
    """Runs of openings, braces that open nothing and braces in strings, against json at each brace in turn."""
    parts = ["{", "}", '"', ":", ",", "[", "]", " ", "\n", "\\", "1", "a", '"a":', '{"a":', '{"b" : ', "{}", "null", '"x"', '"{"']
    draw = random.Random(5)

    def plain(text):
        found, at = [], text.find("{")
        while at >= 0:
            try:
                end = at + json.JSONDecoder().raw_decode(text[at:])[1]
                found.append(text[at:end])
            except ValueError:
                end = at + 1
            at = text.find("{", end)
        return found

    for _ in range(20000):
        text = "".join(draw.choices(parts, k=draw.randrange(1, 30)))
        assert objects_in(text) == plain(text), text


def test_braces_that_open_nothing_are_not_read_one_by_one(monkeypatch):
    from alertloom.functions import jsontext

    tried = []
    read = jsontext._read
    monkeypatch.setattr(jsontext, "_read", lambda *a: tried.append(a[1]) or read(*a))
    assert objects_in("{" * 500 + '"{"n": 7}') == ['{"n": 7}'] and len(tried) <= 2
