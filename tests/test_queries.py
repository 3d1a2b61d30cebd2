"""Every registered query against its SQL, or for the others that it yields rows."""

import pytest
from compare import assert_same, oracle

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    made = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        assert_same(made, con.execute(SQL[name]).df())
    assert len(made) > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    made = contract.entry(spark)
    assert made.columns[:3] == ["site", "time", "energy_kwh"]
    assert made.count() > 0
