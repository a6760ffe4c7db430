"""W1, W5 and W6 in place: only the partitions that a change touches are rewritten.

The tables are Spark catalog tables partitioned by a column that the change never alters (``layouts.save_for_updates``).
A change is given as a condition, or as keys of another table, and runs in three steps:

1. the partitions that hold an affected row: one distinct over the partition column of the affected rows;
2. their new rows, read from those partitions alone (dynamic pruning by step 1) and written to the checkpoint folder,
   since a table can't be read while it is overwritten;
3. a dynamic partition overwrite; partitions of which no row is left are dropped, which an overwrite doesn't do.

Files of other partitions stay as they are.  A job that fails before step 3 has changed nothing, and a repeated W1 or W6
finds nothing left to do; a repeated W5 reprices once more, as the UPDATE would.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import MONEY_TYPE
from tillroll.functions.times import ntz
from tillroll.plans.session import ensure_checkpoint_dir
from tillroll.sources.schema import SCHEMAS, RetailTables

#: The partition column of each table that can be changed in place.
PARTITION_COLUMNS = {"invoice": "invoice_month", "product": "product_range", "payment": "payment_range"}
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Changed:
    table: DataFrame     # the table after the change, without its partition column
    affected: DataFrame  # what RETURNING gave, as of before the change
    partitions: int      # partitions rewritten or dropped


def _checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewrite(t: RetailTables, name: str, affected: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Replace each partition of table ``name`` that has a row in ``affected`` by ``change`` of its rows."""
    spark, by = affected.sparkSession, PARTITION_COLUMNS[name]
    table = f"{t.database}.{name}"
    touched = _checkpointed(affected.select(by).distinct())  # a row a partition: as few as the table has directories
    n = touched.count()
    if not n:
        return 0
    current = spark.table(table)
    # a partition whose column is NULL has a NULL-safe key
    new = _checkpointed(change(current.join(F.broadcast(touched.withColumnRenamed(by, "_part")), F.col(by).eqNullSafe(F.col("_part")), "left_semi"))
                        .select(*current.columns))
    left = new.select(by).distinct()
    gone = [r[0] for r in touched.join(left, touched[by].eqNullSafe(left[by]), "left_anti").collect()]
    mode = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")
    try:
        new.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE, mode)
    for value in gone:  # at most one statement a partition
        spec = "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({by} = {spec})")
    spark.catalog.refreshTable(table)
    return n


def _after(t: RetailTables, name: str) -> DataFrame:
    return t.country.sparkSession.table(f"{t.database}.{name}").select(*SCHEMAS[name].fieldNames())


def _holds(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def mark_shipped_in_place(t: RetailTables, as_of: datetime, days: int = 7) -> Changed:
    """PAID invoices dated strictly before ``as_of - days`` become SHIPPED; months without one keep their files."""
    due = (F.col("status") == "PAID") & (F.col("invoice_date") < ntz(as_of - timedelta(days=days)))
    hit = t.country.sparkSession.table(f"{t.database}.invoice").filter(due)
    affected = _checkpointed(hit.select("invoice_id", F.lit("SHIPPED").alias("status")))
    n = rewrite(t, "invoice", hit, lambda rows: rows.withColumn("status", F.when(_holds(due), F.lit("SHIPPED")).otherwise(F.col("status"))))
    return Changed(_after(t, "invoice"), affected, n)


def reprice_category_in_place(t: RetailTables, category: str, factor=Decimal("1.10")) -> Changed:
    """unit_price = ROUND(unit_price * factor, 2) of the products in ``category``; other id ranges keep their files."""
    cat_ids = t.category.filter(F.col("name") == category).select("category_id")
    targets = _checkpointed(t.product_category.join(cat_ids, "category_id", "left_semi").select("product_id").distinct())
    price = F.round(F.col("unit_price") * F.lit(Decimal(str(factor))), 2).cast(MONEY_TYPE)
    hit = t.country.sparkSession.table(f"{t.database}.product").join(targets, "product_id", "left_semi")
    affected = _checkpointed(hit.select("product_id", price.alias("unit_price")))
    marked = targets.withColumn("_hit", F.lit(True))
    n = rewrite(t, "product", hit, lambda rows: rows.join(marked, "product_id", "left").withColumn(
        "unit_price", F.when(_holds(F.col("_hit")), price).otherwise(F.col("unit_price"))))
    return Changed(_after(t, "product"), affected, n)


def purge_small_refunds_in_place(t: RetailTables, limit=Decimal("1")) -> Changed:
    """Payments with amount < 0 and ABS(amount) < ``limit`` go; a range of which none is left is dropped."""
    bound = F.lit(Decimal(str(limit)))
    small = (F.col("amount") < 0) & (F.col("amount") > -bound)
    hit = t.country.sparkSession.table(f"{t.database}.payment").filter(small)
    affected = _checkpointed(hit.select("payment_id", "amount"))
    n = rewrite(t, "payment", hit, lambda rows: rows.filter(~_holds(small)))
    return Changed(_after(t, "payment"), affected, n)
