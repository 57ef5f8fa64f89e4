"""Every registered query against its SQL on the smallest tables."""

import pytest

from packgraph.plans.catalogue import ORACLES, QUERIES

from compare import DATA, duck, same


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    same(QUERIES[name](spark, DATA), con, ORACLES[name])


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_positive_predicates_reach_the_scan(spark):
    plan = QUERIES["where_range"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity" in plan and "LessThan(l_quantity" in plan
