"""Every registered query with SQL must agree with it exactly."""

import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["attending_physician", "total_patients"]
    assert df.count() > 0
