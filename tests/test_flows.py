import json

import pytest

from alertloom.plans import flows as W
from alertloom.operators import incidents as I
from alertloom.sources.alerts import read_alerts


@pytest.fixture(scope="module")
def alerts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("flow") / "alerts.json"
    path.write_text("\n".join(json.dumps(x) for x in (
        {"Status": "Incident", "ID": "i1", "CorrelID": ["e1", "e2"], "Source": [{"IP": "10.0.0.1"}]},
        {"Status": "Incident", "ID": "i2", "CorrelID": ["gone"]},
        {"Status": "Event", "ID": "e1", "Severity": "High", "Description": "to 1.1.1.1", "StartTime": "2024-01-01T10:00:00Z"},
        {"Status": "Event", "ID": "e2", "Severity": "High", "Description": "to 2.2.2.2", "StartTime": "2024-01-01T10:05:00Z"})))
    return read_alerts(spark, str(path))


def test_reports(alerts):
    rows = {r["incident_id"]: r for r in W.report_alerts(alerts).collect()}
    assert rows["i1"]["event_count"] == 2 and "2 events to to [HIGH]" in rows["i1"]["analysis"]
    assert rows["i2"]["analysis"] == "Incident i2: No associated events found"


@pytest.mark.parametrize("kind, want", [
    ("summary", "AI: ok 🧠 Stats: 3"), ("behavior", "ok 🧠 Stats: 3"), ("cause", "ok"), ("risk", "ok")])
def test_analyses(alerts, kind, want):
    linked = I.link_events(I.explode_links(alerts.incidents), alerts.events)
    rows = {r["incident_id"]: r for r in W.model_analyses(
        alerts.incidents, linked, lambda p: "AI: ok 🧠 Stats: 3 ", kind).collect()}
    assert rows["i1"][kind] == want and rows["i1"]["event_count"] == 2
    assert rows["i2"][kind] == "Incident i2: No associated events found"

    def fails(prompt):
        raise ValueError("down")

    failed = W.model_analyses(alerts.incidents, linked, fails, kind, grouped=False).where("incident_id = 'i1'").first()
    assert failed[kind] == W.ANALYSES[kind][0].format(incident="i1") + "down"


def test_signature_generation(spark):
    def model(prompt):
        return 'signature a {\n event "x"\n}' if "HTTP" in prompt else "no"

    rows = W.generated_signatures(spark, 5, model, document="manual").collect()
    assert 0 < len(rows) <= 5 and all(r["output"].startswith("signature a") for r in rows)
    assert all(r["instruction"] and r["input"] for r in rows)
