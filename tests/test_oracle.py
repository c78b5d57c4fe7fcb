"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracle import connection, difference


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_twin(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    if name in entry.oracle_sql():
        assert difference(df, con, entry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"incident_id", "severity", "target_summary", "events"} <= set(df.columns)
    assert df.count() > 0
