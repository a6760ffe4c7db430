"""Saved layouts: lookups read the partitions of their ids only, joins by invoice need no exchange."""

from dataclasses import replace

import pytest
from conftest import rows

from tillroll.operators import reports as R
from tillroll.sources import layouts
from tillroll.sources.layouts import range_of, save_bucketed, save_ranged
from tillroll.sources.starmap import load_star

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF)


@pytest.fixture(scope="module")
def ranged(star):
    return save_ranged(star)


@pytest.fixture(scope="module")
def bucketed(star):
    return save_bucketed(star, buckets=4)


def nodes(plan):
    """Every physical node of an executed plan, those behind adaptive stages too."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    yield kind, plan
    if kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def executed(df):
    """(rows, nodes) after the query has run."""
    out = rows(df)
    return out, list(nodes(df._jdf.queryExecution().executedPlan()))


def files_read(found, part):
    return sum(n.metrics().apply("numFiles").value() for kind, n in found
               if kind == "FileSourceScanExec" and part in n.toString())


def ids_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "invoice_id bigint")


@pytest.mark.parametrize("report, part", [(R.invoice_items, "invoice_line"), (R.invoice_payments, "payment"), (R.invoice_header, "invoice")])
def test_lookups_read_fewer_files_for_fewer_ids(spark, star, ranged, report, part):
    known = sorted(r[0] for r in rows(star.invoices().select("invoice_id")))
    read = []
    for some in (known, known[:100], known[:3], [-5], [None, 10 ** 17]):
        ids = ids_of(spark, some)
        df = report(ranged, ids)
        assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()
        got, found = executed(df)
        assert sorted(got, key=str) == sorted(rows(report(star, ids)), key=str)
        read.append(files_read(found, f".{part}"))
    assert read[0] > read[1] > read[2] >= read[3] == read[4] == 0


def test_balance_of_known_unknown_and_missing_ids(spark, star, ranged):
    ids = ids_of(spark, [1, 2, 2, -9, None])
    got = sorted(rows(R.invoice_balance(ranged, ids)), key=str)
    assert got == sorted(rows(R.invoice_balance(star, ids)), key=str) and len(got) == 4


def test_many_ids_are_not_broadcast(spark, ranged, monkeypatch):
    monkeypatch.setattr(R, "MOST_IDS", 2)
    ids = ids_of(spark, range(1, 9))
    df = R.invoice_items(ranged, ids)
    assert "hint" not in df._jdf.queryExecution().analyzed().toString().lower()
    assert sorted(rows(df), key=str) == sorted(rows(R.invoice_items(replace(ranged, range_width=None), ids)), key=str)


def test_ranges_of_any_id(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(-11,), (-10,), (-1,), (0,), (9,), (10,), (2 ** 63 - 1,), (-(2 ** 63),)], "k bigint")
    got = [r[0] for r in rows(df.select(range_of(F.col("k"), 10)))]
    assert got == [-2, -1, -1, 0, 0, 1, (2 ** 63 - 1) // 10, -(2 ** 63) // 10]


REPORTS = [R.revenue_by_country, R.avg_order_value, R.partial_refunds, R.invoices_above_average, R.invoice_refund_flags]


@pytest.mark.parametrize("report", REPORTS)
def test_bucketed_joins_need_no_exchange_by_invoice(spark, star, bucketed, report):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        df = report(bucketed)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not [line for line in exchanges if "(invoice_id" in line], exchanges
        plain = report(star)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(invoice_id" in plain or "Exchange hashpartitioning(l_orderkey" in plain or report is R.invoices_above_average
        assert sorted(rows(df), key=str) == sorted(rows(report(star)), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_tables_can_be_saved(spark, star):
    none = star.with_tables(invoice=star.invoice.limit(0), invoice_line=star.invoice_line.limit(0), payment=star.payment.limit(0))
    for save in (save_ranged, save_bucketed):
        saved = save(none)
        assert rows(R.invoice_items(saved, ids_of(spark, [1]))) == [] and rows(R.revenue_by_country(saved)) == []


def test_buckets_grow_with_the_rows(spark, star, monkeypatch):
    count = lambda t: int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {t.database}.invoice_line").collect()
                               if r.col_name == "Num Buckets"))
    assert count(save_bucketed(star)) == layouts.BUCKETS
    monkeypatch.setattr(layouts, "BUCKET_ROWS", 100)
    saved = save_bucketed(star)
    lines = star.invoice_line.count()
    assert count(saved) == -(-lines // 100) > layouts.BUCKETS and saved.invoice_line.count() == lines
    assert sorted(rows(R.partial_refunds(saved))) == sorted(rows(R.partial_refunds(star)))


def test_tasks_of_a_partitioned_write_are_small(spark, star, monkeypatch, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    files = lambda t: len(t.invoice_line.inputFiles())
    star.invoice_line.repartition(8).write.parquet(f"{tmp_path}/lines")  # what one map task sends isn't split
    star = star.with_tables(invoice_line=spark.read.parquet(f"{tmp_path}/lines"))
    large = save_ranged(star, ranges=1)
    monkeypatch.setattr(layouts, "PIECE", "20k")
    small = save_ranged(star, ranges=1)
    assert files(large) < files(small) and spark.conf.get(key, None) == before
    for name in layouts.FACTS:
        assert sorted(rows(small.table(name)), key=str) == sorted(rows(large.table(name)), key=str)
