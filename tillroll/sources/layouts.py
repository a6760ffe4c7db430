"""Retail tables as Spark catalog tables with a physical layout, for repeated use.

* ``ranged``: invoices, lines and payments are partitioned by ranges of the invoice id, so that a lookup by ids
  reads the partitions of these ids only (dynamic partition pruning), and a change rewrites the partitions it touches.
* ``bucketed``: the same tables are bucketed and sorted by invoice id, so that the joins and groups by invoice, which
  most reports start with, need no exchange.
* ``monthly``: invoices by month and products by id range, for updates of the invoices of some months or of one category.

The tables belong to a database of their own in the checkpoint folder, which all executors share; dropping it drops them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.plans.session import ensure_checkpoint_dir
from tillroll.sources.schema import SCHEMAS, RetailTables

FACTS = ("invoice", "invoice_line", "payment")
#: Ranges of ids (directories) that a ranged table gets about.
RANGES = 64
#: Shuffled bytes that a task of a partitioned write gets about: it sorts its rows by directory, in memory.
PIECE = "16m"
#: Buckets that a bucketed table gets at least and at most, and the rows that one holds about.
BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 32, 65536, 1 << 19


def new_database(spark: SparkSession) -> str:
    """An empty database whose tables lie in the checkpoint folder."""
    name = f"tillroll_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}'")
    return name


def range_of(key: Column, width: int) -> Column:
    """Number of the id range; the ranges of negative ids are negative, so that every id has one."""
    return F.floor(key.cast("decimal(20,0)") / F.lit(width)).cast("bigint")


def _width(table: DataFrame, key: str, ranges: int) -> int:
    low, high = table.agg(F.min(key), F.max(key)).first()
    return 1 if low is None else max(1, -(-(high - low + 1) // ranges))


@contextmanager
def _pieces(spark: SparkSession, size: str) -> Iterator[None]:
    """The size of the parts that ``rebalance`` makes, for the writes inside."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _partitioned(table: DataFrame, by: str, name: str) -> None:
    """``rebalance`` brings a partition's rows together but splits a large one over several tasks; their number grows
    with the table, so that none has to spill what it sorts."""
    with _pieces(table.sparkSession, PIECE):
        table.hint("rebalance", by).write.partitionBy(by).format("parquet").saveAsTable(name)


def save_ranged(t: RetailTables, ranges: int = RANGES, width: int | None = None) -> RetailTables:
    """The facts partitioned by ``invoice_range``; the other tables stay as they are."""
    spark = t.country.sparkSession
    database = new_database(spark)
    width = width or _width(t.invoices(), "invoice_id", ranges)
    saved = {}
    for name in FACTS:
        columns = SCHEMAS[name].fieldNames()
        _partitioned(t.table(name).select(*columns, range_of(F.col("invoice_id"), width).alias("invoice_range")), "invoice_range", f"{database}.{name}")
        saved[name] = spark.table(f"{database}.{name}")
    return replace(t, **saved, invoice_core=None, range_width=width, database=database)


def _buckets(t: RetailTables) -> int:
    """Buckets for these tables, as a bucket is sorted by one task when it is written and again in each join.

    Payments aren't counted: some sources have to derive them, and an invoice has about as many as lines.
    """
    rows = max(t.invoices().count(), t.invoice_line.count())
    return min(MOST_BUCKETS, max(BUCKETS, -(-rows // BUCKET_ROWS)))


def save_bucketed(t: RetailTables, buckets: int | None = None) -> RetailTables:
    """The facts bucketed and sorted by ``invoice_id``; one invoice of most lines fills one bucket but no shuffle."""
    spark = t.country.sparkSession
    database = new_database(spark)
    buckets = buckets or _buckets(t)
    saved = {}
    for name in FACTS:
        (t.table(name).select(*SCHEMAS[name].fieldNames()).repartition(buckets, "invoice_id")
         .write.bucketBy(buckets, "invoice_id").sortBy("invoice_id").format("parquet").saveAsTable(f"{database}.{name}"))
        saved[name] = spark.table(f"{database}.{name}")
    return replace(t, **saved, invoice_core=None, database=database)


def save_for_updates(t: RetailTables, ranges: int = RANGES, names: tuple[str, ...] = ("invoice", "product", "payment")) -> RetailTables:
    """Invoices by month (``invoice_month``), products and payments by id range: columns that no update changes."""
    spark = t.country.sparkSession
    database = new_database(spark)
    by_range = lambda name, key: range_of(F.col(key), _width(t.table(name), key, ranges))
    parts = {
        "invoice": ("invoice_month", lambda: F.date_format("invoice_date", "yyyy-MM")),
        "product": ("product_range", lambda: by_range("product", "product_id")),
        "payment": ("payment_range", lambda: by_range("payment", "payment_id")),
    }
    saved = {}
    for name in names:
        by, value = parts[name]
        _partitioned(t.table(name).select(*SCHEMAS[name].fieldNames(), value().alias(by)), by, f"{database}.{name}")
        saved[name] = spark.table(f"{database}.{name}")
    return replace(t, **saved, invoice_core=None, database=database)


_SAVED: dict[tuple, RetailTables] = {}


def saved_once(t: RetailTables, key: tuple, save) -> RetailTables:
    """``save(t)`` once for each session and ``key``: loading is not part of every report."""
    spark = t.country.sparkSession
    key = (spark.sparkContext.applicationId, id(spark), *key, save.__name__)
    if key not in _SAVED:
        _SAVED[key] = save(t)
    return _SAVED[key]
