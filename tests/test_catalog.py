"""Every registered query against its SQL, on the smallest data; `check.py` does the same on larger data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and {"characteristic", "level", "lower_ci", "upper_ci"} <= set(df.columns)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, sf, name):
    assert compare(spark, con, name, sf) is None


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_has_no_python_and_no_cross_join(spark, sf, name):
    text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text
