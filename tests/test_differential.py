"""Every registered query against its DuckDB oracle text on the driver tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tillroll.plans.catalog import all_queries
from tillroll.plans.diffcheck import compare, duckdb_connection

SF_DIR = os.environ.get("TILLROLL_TEST_SF", "/root/testdata/sf0.001")
QUERIES = all_queries()  # the corpus queries have tests of their own
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(SQL) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    result = compare(spark, SF_DIR, name, QUERIES[name], SQL[name], con)
    assert result["match"], result


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["country", "revenue"]
    assert df.count() == 25


@pytest.fixture
def no_auto_broadcast(spark):
    """Plan as for tables too large to broadcast: sort-merge / shuffled joins."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle_with_shuffle_joins(spark, con, no_auto_broadcast, name):
    result = compare(spark, SF_DIR, name, QUERIES[name], SQL[name], con)
    assert result["match"], result
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
