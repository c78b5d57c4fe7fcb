"""All registered queries."""

from __future__ import annotations

from alertloom.plans import alerts, datasets, files, prompting, ranking, roundtrips, sampling, texts, workflows

_FAMILIES = (alerts, sampling, datasets, ranking, texts, files, workflows, roundtrips, prompting)

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
