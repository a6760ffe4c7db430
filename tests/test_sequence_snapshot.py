"""Key assignment, running sums (hot key) and snapshot publication."""

import tempfile
from decimal import Decimal as D

from conftest import T0, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.functions.sequence import assign_keys, running_sum
from tillroll.operators import reports as R
from tillroll.operators import writes as W
import pytest

from tillroll.sources.tables import (load_tables, manifest, payments_from_totals, payments_from_totals_rejected,
                                     write_snapshot)


def test_assign_keys_matches_row_number(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("k"),
                                     (F.col("id") % 3).alias("g"))
    got = assign_keys(df, "key", ["k", "g"], start=100)
    want = df.withColumn("key", 100 + F.row_number().over(Window.orderBy("k", "g")))
    assert sorted(rows(got, "k", "g", "key")) == sorted(rows(want, "k", "g", "key"))


def test_assign_keys_scalar_start(spark, seed):
    start = F.coalesce(seed.invoice.agg(F.max("invoice_id")).scalar(), F.lit(0))
    got = assign_keys(spark.createDataFrame([(5,), (3,)], "x long"), "id", ["x"], start)
    assert sorted(rows(got)) == [(3, 7), (5, 8)]


def test_running_sum_with_a_hot_key(spark):
    # key 0 holds a third of all rows; the helper must agree with the plain window
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("o"), (F.col("id") % 17).cast("decimal(12,2)").alias("v"))
    got = running_sum(df, ["k"], ["o"], F.col("v"), "rs")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("rs", F.sum("v").over(w))
    assert sorted(rows(got, "k", "o", "rs")) == sorted(rows(want, "k", "o", "rs"))


def test_running_sum_null_key(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), (1, 1, 5)], "k long, o long, v long")
    got = sorted(rows(running_sum(df, ["k"], ["o"], "v", "rs"), "k", "o", "rs"),
                 key=lambda r: (r[0] is None, r))
    assert got == [(1, 1, 5), (None, 1, 2), (None, 2, 5)]


def test_payments_from_totals(spark, seed):
    got = payments_from_totals(seed, seed.invoice.filter("invoice_id in (1, 3)"), "CARD", T0)
    assert sorted(rows(got, "payment_id", "invoice_id", "amount")) == [
        (8, 1, D("26.50")), (9, 3, D("32.50"))]


def test_snapshot_round_trip(spark, seed):
    root = tempfile.mkdtemp(prefix="tillroll-snap-", dir="/tmp")
    first = write_snapshot(seed, root, "0001")
    t1 = load_tables(spark, root)
    assert rows(R.net_profit(t1)) == [(D("122.19"),)]
    purged = W.purge_small_refunds(t1, D("10"))  # removes the -5.00 refund
    second = write_snapshot(purged.tables, root, "0002", base=t1, base_paths=first)
    assert second["payment"] != first["payment"]
    assert second["invoice"] == first["invoice"]  # unchanged tables are not rewritten
    assert manifest(spark, root) == second
    assert rows(R.net_profit(load_tables(spark, root))) == [(D("127.19"),)]
    assert rows(R.net_profit(load_tables(spark, root, "0001"))) == [(D("122.19"),)]


def test_materialized_star_equals_lazy_mapping(spark):
    from tillroll.sources.starmap import load_star
    sf = "/root/testdata/sf0.001"
    lazy, stored = load_star(spark, sf, materialize=False), load_star(spark, sf, materialize=True)
    for name in ("invoice", "invoice_line", "payment", "category"):
        a, b = lazy.table(name), stored.table(name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    assert rows(R.partial_refunds(stored)) and sorted(rows(R.revenue_by_country(stored))) == sorted(
        rows(R.revenue_by_country(lazy)))


def test_invoice_without_lines_gets_no_payment(spark, seed):
    wanted = seed.invoice.select("invoice_id").union(spark.createDataFrame([(77,)], "invoice_id long"))
    assert payments_from_totals(seed, wanted, "CARD", T0).filter("amount IS NULL OR invoice_id = 77").count() == 0
    assert rows(payments_from_totals_rejected(seed, wanted), "invoice_id") == [(77,)]


def test_unreadable_snapshot_is_refused_and_a_failed_one_can_be_repeated(spark, seed):
    root = tempfile.mkdtemp(prefix="tillroll-snap-", dir="/tmp")
    write_snapshot(seed, root, "0002")
    with pytest.raises(ValueError):
        write_snapshot(seed, root, "0001")
    broken = seed.with_tables(payment=seed.payment.withColumn("amount", F.raise_error(F.lit("lost")).cast("decimal(12,2)")))
    with pytest.raises(Exception, match="lost"):
        write_snapshot(broken, root, "0003")
    assert manifest(spark, root)["payment"].count("/data/0002-") == 1
    write_snapshot(seed, root, "0003")
    assert load_tables(spark, root).payment.count() == seed.payment.count()


def test_ids_that_would_clash_fail_loudly(spark):
    from tillroll.sources import starmap
    line = spark.createDataFrame([(1, 1, 1, 1000, 1.0, 5.0, 0.0, 0.0, "N", "O", None)], starmap.RAW_SCHEMAS["lineitem"])
    with pytest.raises(Exception, match="id stride"):
        starmap.invoice_line(line).collect()
