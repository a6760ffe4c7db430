"""Plan assertions: the physical plans have the intended shape."""

import pytest

from tillroll.plans.catalog import all_queries as queries

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cartesian_or_python_in_plans(spark, name):
    # a runtime filter that Spark adds to a join by itself isn't an aggregate of the operator
    p = "\n".join(line for line in plan(queries()[name](spark, SF_DIR)).splitlines() if "bloom_filter_agg" not in line)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas", "SortAggregate",
                "ObjectHashAggregate"):
        assert bad not in p, f"{name}: {bad}"


def test_anti_joins_are_explicit(spark):
    for name in ("customers_without_orders", "products_never_ordered"):
        assert "LeftAnti" in optimized(queries()[name](spark, SF_DIR))


def test_top_customers_windows_only_the_limited_rows(spark):
    text = optimized(queries()["top_customers"](spark, SF_DIR))
    window_at = text.index("Window [rank(")
    assert "GlobalLimit 3" in text[window_at:], "the rank window must sit above the limit"


def test_fact_tables_are_aggregated_before_the_join(spark):
    text = plan(queries()["revenue_by_country"](spark, SF_DIR))
    # partial aggregation of lineitem directly above its scan
    assert "partial_sum" in text
    scan = text.index("lineitem")
    assert text.rfind("HashAggregate", 0, scan) != -1


def test_filters_and_columns_reach_the_scan(spark):
    df = queries()["customers_without_orders_since"](spark, SF_DIR)
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_shuffle_joins_reuse_the_aggregate_partitioning(spark):
    """Planned as for large tables (no broadcast): each join key is shuffled
    once per side — the pre-aggregated fact side is not shuffled again."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        text = plan(queries()["revenue_by_country"](spark, SF_DIR))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    for key in ("invoice_id", "customer_id"):
        assert text.count(f"Exchange hashpartitioning({key}") == 2, key


def test_write_conditions_reach_the_scan(spark):
    text = plan(queries()["mark_shipped_affected"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in text


def test_requested_invoices_are_filtered_before_the_aggregate(spark):
    text = plan(queries()["invoice_balance"](spark, SF_DIR))
    scan = text.index("lineitem")
    assert text.rfind("LeftSemi", 0, scan) > text.rfind("partial_sum", 0, scan) > 0


def test_references_are_distinct_before_the_semi_join(spark):
    text = plan(queries()["cascade_delete_refused"](spark, SF_DIR))
    assert "LeftSemi" in text and text.count("HashAggregate(keys=[customer_id") >= 2


def test_rejects_need_no_job_to_be_built(spark):
    """Building the rejects writes no checkpoint: the plan starts at the scans."""
    for name in ("place_orders_rejected", "record_refunds_rejected"):
        text = plan(queries()[name](spark, SF_DIR))
        assert "Scan ExistingRDD" not in text and "RDDScan" not in text, name


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_requested_invoices_are_hashed(spark, no_broadcast):
    """Neither lines nor payments are sorted, and one aggregate sums up both."""
    text = plan(queries()["invoice_balance"](spark, SF_DIR))
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text and "Sort [" not in text


def test_a_cascade_counts_without_sorting_its_tables(spark, no_broadcast):
    text = plan(queries()["cascade_delete_removed"](spark, SF_DIR))
    assert "SortMergeJoin [invoice_id" not in text and "SortMergeJoin [l_orderkey" not in text
    assert text.count("ShuffledHashJoin") >= 3
