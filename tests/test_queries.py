"""Every registered query runs; where it has SQL, DuckDB gives the same rows."""

import pytest
from conftest import TINY
from helpers import duck_rows, spark_rows

from millrace.queries import catalog

SLOW = {"tree_and_forest"}


@pytest.mark.parametrize("name", sorted(catalog.SQL.keys() - SLOW))
def test_same_rows_as_sql(spark, duck, name):
    assert spark_rows(catalog.QUERIES[name](spark, TINY)) == duck_rows(duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys() - SLOW))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, TINY)
    assert df.columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["range_lookup"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice,100000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_grouped_windows_shuffle_once(spark):
    df = catalog.QUERIES["ts_sma"](spark, TINY)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
