import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from alertloom.operators import datasets as D
from alertloom.sources import analyses as N


def record(i, **more):
    return {"incident_id": i, "category": "Normal", "source_ip": "1.1.1.1", "timewindow": "1",
            "timeline": "t", "threat_level": 1.5, "event_count": 3, **more}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("analyses")
    documents = {
        "x.dag.json": [record("a", analysis="A1"), {"analysis": "lost"}, record("b", category="Malware", analysis="B1")],
        "y.dag.json": {"total_incidents": 1, "incidents": [record("a", source_ip="2.2.2.2", analysis="A2")]},
        "x.llm.phi-4.json": [record("c", summary="S", behavior_analysis=None)],
        "odd.json": {"rows": []},
        "text.json": "nothing",
    }
    for name, document in documents.items():
        (base / name).write_text(json.dumps(document, indent=1))
    return base


def read(spark, files, *names, shape="any"):
    return N.read_analyses(spark, [str(files / n) for n in names], shape)


def test_shapes(spark, files):
    everything = ("x.dag.json", "y.dag.json", "odd.json", "text.json")
    found = read(spark, files, *everything)
    assert found.records.count() == 4 and found.rejects.count() == 2
    assert read(spark, files, *everything, shape="wrapped").records.count() == 1
    assert read(spark, files, *everything, shape="array").records.count() == 3
    with pytest.raises(ValueError):
        read(spark, files, "odd.json", shape="round")


def test_correlate_files(spark, files):
    records = read(spark, files, "x.dag.json", "y.dag.json", "x.llm.phi-4.json").records
    typed = records.withColumn("analysis_type", N.analysis_type(F.col("source_file"))) \
        .withColumn("payload", D.payload(F.col("present")))
    mapping = spark.createDataFrame([("b", "Mapped")], "incident_id string, mapped_category string")
    rows = {r["incident_id"]: r for r in D.correlate(typed, mapping).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["source_ip"] == "1.1.1.1" and rows["a"]["analyses"] == {"dag": {"analysis": "A2"}}
    assert rows["b"]["category"] == "Mapped"
    # A field that is there but null stays; one that is absent does not appear.
    assert rows["c"]["analyses"] == {"llm_phi_4": {"summary": "S", "behavior_analysis": None}}
    wide = D.wide(D.correlate(typed), ["dag", "llm_phi_4"])
    assert {"dag_analysis", "llm_phi_4_analysis"} <= set(wide.columns)
    assert N.dataset_kind(wide.columns) == "summarisation"


@pytest.mark.parametrize("name, kind", [
    ("d.cause_risk.gpt-4o-mini.json", "cause_risk_gpt_4o_mini"), ("d.cause_risk.qwen2.5:3b.json", "cause_risk_qwen2_5:3b"),
    ("d.dag.json", "dag"), ("d.llm.gpt-4o-mini.json", "llm_gpt4o_mini"), ("d.llm.gpt4o.json", "llm_gpt4o_mini"),
    ("d.llm.qwen2.5.1.5b.json", "llm_qwen2_5_1_5b"), ("d.llm.qwen2.5.json", "llm_qwen2_5"),
    ("d.llm.qwen2_5.json", "llm_qwen2_5"), ("d.llm.qwen.json", "llm_qwen"), ("d.llm.llama3.json", "llm_llama"),
    ("d.llm.phi-4.json", "llm_phi_4"), ("my-data.v2.json", "my-data_v2"),
])
def test_analysis_type(spark, name, kind):
    row = spark.createDataFrame([Row(path=f"/some.dir/{name}")])
    assert row.select(N.analysis_type(F.col("path"))).first()[0] == kind


def test_category_mapping_takes_the_last_line(spark):
    lines = spark.createDataFrame([("a", "X", 1), ("a", "Y", 2), ("", "Z", 3), ("b", None, 4)],
                                  "incident_id string, category string, line_order int")
    assert {r[0]: r[1] for r in D.category_mapping(lines).collect()} == {"a": "Y", "b": "Unknown"}


@pytest.fixture(scope="module")
def inputs(spark):
    schema = "incident_id string, pos int, category string, source_file string"
    first = spark.createDataFrame([("a", 0, "1", "x"), ("b", 1, "1", "x"), ("a", 2, "2", "x"), ("", 3, "1", "x")], schema)
    second = spark.createDataFrame([("b", 0, "3", "y"), (None, 1, "3", "y"), ("c", 2, "3", "y")], schema)
    return D.stacked([first, second])


def test_merge_keeps_the_first(spark, inputs):
    rows = {r["incident_id"]: r["category"] for r in D.merge_first(inputs).collect()}
    assert rows == {"a": "1", "b": "1", "c": "3"}
    counts = D.merge_counts(inputs, D.merge_first(inputs)).first()
    assert tuple(counts) == (7, 3, 3, 4)
    repeats = {(r["incident_id"], r["source_file"]): r["copies"] for r in D.duplicate_ids(inputs).collect()}
    assert repeats == {("a", "x"): 2, ("b", "x"): 1, ("b", "y"): 1}


def checks(inputs, output):
    return {r["check"]: r["passed"] for r in D.verify_merge(inputs, output).collect()}


def test_verify_finds_each_fault(spark):
    schema = ("incident_id string, pos int, category string, source_ip string, timewindow string, "
              "timeline string, threat_level double, event_count int, source_file string")
    rows = [(i, n, "c", "s", "w", "t", 1.0, 2, "f") for n, i in enumerate("abc")]
    good = spark.createDataFrame(rows, schema)
    assert all(checks(good, good).values())
    failed = {name for name, ok in checks(good, good.where("incident_id <> 'b'")).items() if not ok}
    assert failed == {"counts", "complete", "overall"}
    doubled = good.union(spark.createDataFrame([("c", 3, "c", "s", "w", "t", 1.0, 2, "f")], schema))
    assert {n for n, ok in checks(good, doubled).items() if not ok} == {"counts", "no_repeats", "overall"}
    turned = good.withColumn("pos", -F.col("pos"))
    assert {n for n, ok in checks(good, turned).items() if not ok} == {"sorted", "overall"}
    holed = good.withColumn("timeline", F.when(F.col("incident_id") != "a", F.col("timeline")))
    assert {n for n, ok in checks(good, holed).items() if not ok} == {"integrity", "overall"}
    assert not checks(good, good)["overall"] is None


def test_integrity_reads_the_json_text(spark):
    raw = [json.dumps(r) for r in (
        record("a"), record("b", threat_level="high"), record("c", event_count=2.5), record("d", timeline=None),
        {k: v for k, v in record("e").items() if k != "timeline"}, record(""), record("f", event_count=None))]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    df = df.select("raw", F.json_object_keys("raw").alias("present"),
                   F.get_json_object("raw", "$.incident_id").alias("incident_id"))
    assert tuple(D.integrity(df).first()) == (1, 1, 3)


@pytest.mark.parametrize("width", [2, 7, 1000])
def test_inversions_at_any_width(spark, width):
    values = [f"{(i * 37) % 101:03d}" for i in range(300)]
    want = sum(a > b for a, b in zip(values, values[1:]))
    rows = spark.createDataFrame([(n * 3, v) for n, v in enumerate(values)], "pos bigint, id string")
    assert D.inversions(rows, "pos", "id", width).first()[0] == want


def test_record_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(record(i)) for i in "abc"))
    rows = N.read_record_lines(spark, [str(tmp_path / "a.jsonl")])
    assert rows.count() == 3 and D.integrity(rows).first()["missing_fields"] == 0
