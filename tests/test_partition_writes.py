"""Changes in place: the state of the pure operators, with the files of untouched partitions left alone."""

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillroll.operators import partition_writes as PW
from tillroll.operators import writes as W
from tillroll.sources.layouts import save_for_updates
from tillroll.sources.starmap import load_star

AS_OF = datetime(1998, 6, 15)


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, "/root/testdata/sf0.001")


def files(spark, saved, name):
    """Partition value -> its files."""
    by = PW.PARTITION_COLUMNS[name]
    found = {}
    for value, path in rows(spark.table(f"{saved.database}.{name}").select(F.col(by), F.input_file_name()).distinct()):
        found.setdefault(value, set()).add(path)
    return found


def same_rows(a, b):
    return sorted(rows(a), key=str) == sorted(rows(b), key=str)


def test_mark_shipped_rewrites_the_months_of_paid_invoices(spark, star):
    saved = save_for_updates(star, names=("invoice",))
    before = files(spark, saved, "invoice")
    changed = PW.mark_shipped_in_place(saved, AS_OF, days=7)
    pure = W.mark_shipped(star, AS_OF, days=7)
    assert same_rows(changed.table, pure.tables.invoice) and same_rows(changed.affected, pure.affected)
    after = files(spark, saved, "invoice")
    kept = {m for m in before if after[m] == before[m]}
    assert {m for m in before if m > "1998-06"} <= kept and 0 < changed.partitions == len(before) - len(kept)
    again = PW.mark_shipped_in_place(saved, AS_OF, days=7)
    assert again.partitions == 0 and rows(again.affected) == [] and files(spark, saved, "invoice") == after


def test_reprice_rewrites_the_ranges_of_the_category(spark, star):
    one = rows(star.product_category.join(star.category, "category_id").groupBy("name").count().orderBy("count", "name").limit(1))[0][0]
    saved = save_for_updates(star, names=("product",), ranges=40)
    before = files(spark, saved, "product")
    changed = PW.reprice_category_in_place(saved, one, Decimal("1.10"))
    pure = W.reprice_category(star, one, Decimal("1.10"))
    assert same_rows(changed.table, pure.tables.product) and same_rows(changed.affected, pure.affected)
    after = files(spark, saved, "product")
    assert len([r for r in before if before[r] != after[r]]) == changed.partitions < len(before)
    assert PW.reprice_category_in_place(saved, "no such category").partitions == 0


def test_purge_drops_ranges_that_are_left_empty(spark, star):
    low = star.payment.filter(F.col("payment_id") < 200_000).withColumn("amount", F.lit(Decimal("-0.50")).cast("decimal(12,2)"))
    t = star.with_tables(payment=low.unionByName(star.payment.filter(F.col("payment_id") >= 200_000)))
    saved = save_for_updates(t, names=("payment",), ranges=30)
    before = files(spark, saved, "payment")
    changed = PW.purge_small_refunds_in_place(saved, Decimal("1"))
    pure = W.purge_small_refunds(t, Decimal("1"))
    assert same_rows(changed.table, pure.tables.payment) and same_rows(changed.affected, pure.affected)
    after = files(spark, saved, "payment")
    gone = set(before) - set(after)
    assert gone and all(after[r] == before[r] for r in after if r not in range(min(gone), max(gone) + 2))
    left = {r[0] for r in rows(spark.sql(f"SHOW PARTITIONS {saved.database}.payment"))}
    assert left == {f"payment_range={r}" for r in after}


def test_partitions_without_a_value(spark, star):
    undated = star.invoice.withColumn("invoice_date", F.when(F.col("invoice_id") % 3 > 0, F.col("invoice_date")))
    saved = save_for_updates(star.with_tables(invoice=undated), names=("invoice",))
    due = F.col("invoice_date").isNull()
    hit = spark.table(f"{saved.database}.invoice").filter(due)
    n = hit.count()
    assert n and PW.rewrite(saved, "invoice", hit, lambda df: df.withColumn("status", F.lit("SHIPPED"))) == 1
    table = spark.table(f"{saved.database}.invoice")
    assert table.filter(due & (F.col("status") == "SHIPPED")).count() == n and table.count() == undated.count()
    assert PW.rewrite(saved, "invoice", spark.table(f"{saved.database}.invoice").filter(due), lambda df: df.limit(0)) == 1
    assert spark.table(f"{saved.database}.invoice").filter(due).count() == 0


def test_empty_table(spark, star):
    saved = save_for_updates(star.with_tables(invoice=star.invoice.limit(0)), names=("invoice",))
    assert PW.mark_shipped_in_place(saved, AS_OF).partitions == 0
