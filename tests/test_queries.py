"""Every registered query: against DuckDB where SQL can say it, else that it gives rows."""

import os

import pytest

import __spark_entry__ as registered
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registered.queries()
SQL = registered.oracle_sql()
# With 200 entities no feature has the 1,000 values that outlier rates ask for.
MAY_BE_EMPTY = {"outlier_rates", "outlier_by_family"}


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert rows or name in MAY_BE_EMPTY


def test_entry_gives_one_row_per_cluster(spark):
    assert registered.entry(spark).count() == 3


def test_exact_distinct_count_keeps_no_sketch_per_value(spark):
    from cohortloom.plans.queries_profiling import sketch_consistency

    plan = sketch_consistency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("approx_count_distinct" in line and "Aggregate [entity_id" in line for line in plan.splitlines())
    physical = sketch_consistency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any("keys=[entity_id" in line and "approx_count_distinct" in line for line in physical.splitlines())
