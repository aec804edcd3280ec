"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from muster.plans import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    problem, count, _ = compare(df, duck, sql)
    assert problem is None
    assert count > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["server", "job_id", "node", "port", "state"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
