"""Every registered query against its SQL in DuckDB, on the smallest given tables."""

import os

import pytest

from workload import check, suite

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query_equals_its_sql(spark, name):
    result = check.compare(spark, SF_DIR, name)
    assert result["ok"], result.get("why")


def test_every_query_has_sql():
    assert set(suite.QUERIES) == set(suite.ORACLES)


def test_the_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:5] == ["nfl_id", "n", "name", "pos", "grp"] and df.count() > 0
    assert set(entry.queries()) >= set(suite.QUERIES) and set(entry.oracle_sql()) >= set(suite.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
