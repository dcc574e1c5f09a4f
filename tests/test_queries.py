"""Every registered query against its SQL on whole tables."""
import pytest
from compare import compare, connect

import __spark_entry__ as entry
from gridcast.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["scope", "sensor_id", "site_id"]
    assert out.where("scope = 'all'").count() == 1
