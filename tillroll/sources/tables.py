"""Native retail tables: load, derive seed payments, publish snapshots.

Layout under a root folder (any Hadoop-compatible shared file system):

    <root>/data/<snapshot>/<table>/part-*.parquet   table data
    <root>/_manifests/<snapshot>/part-*.json          (table_name, path) rows

A write operator's result is published by ``write_snapshot``: the changed
tables are written first, each as its own Spark job; the manifest naming every
table's path is written last.  Readers take the newest manifest, so they see
either the previous snapshot or the complete new one, never a mixture, and a
failed publication leaves no manifest behind.  Unchanged tables are not
rewritten: their manifest entry keeps the previous path.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.sequence import assign_keys
from tillroll.functions.times import ntz
from tillroll.sources.schema import SCHEMAS, TABLE_NAMES, RetailTables

MANIFESTS = "_manifests"


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table with its declared schema (no inference, columns in schema order)."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def manifest(spark: SparkSession, root: str, snapshot: str | None = None) -> dict[str, str]:
    """table -> path of the newest (or the given) published snapshot.

    The manifest has one row per table, so collecting it is bounded.
    """
    m = (spark.read.schema("snapshot STRING, table_name STRING, path STRING")
         .option("recursiveFileLookup", "true").json(f"{root.rstrip('/')}/{MANIFESTS}"))
    if snapshot is None:
        snapshot = m.agg(F.max("snapshot")).first()[0]
        if snapshot is None:
            raise FileNotFoundError(f"no published snapshot under {root}")
    rows = m.filter(F.col("snapshot") == snapshot).select("table_name", "path").collect()
    return {r.table_name: r.path for r in rows}


def load_tables(spark: SparkSession, root: str, snapshot: str | None = None) -> RetailTables:
    paths = manifest(spark, root, snapshot)
    missing = set(TABLE_NAMES) - set(paths)
    if missing:
        raise ValueError(f"snapshot lacks tables: {sorted(missing)}")
    return RetailTables(**{name: read_table(spark, paths[name], name) for name in TABLE_NAMES})


def write_snapshot(t: RetailTables, root: str, snapshot: str,
                   base: RetailTables | None = None,
                   base_paths: dict[str, str] | None = None) -> dict[str, str]:
    """Write the tables of ``t`` that differ from ``base`` and publish them.

    ``snapshot`` must sort after every published snapshot (e.g. a zero-padded
    sequence number or an ISO timestamp), else readers would never see it; a
    ValueError refuses it.  The data go to a folder of this attempt, so a
    publication that failed half-way can be tried again.  Returns the manifest.
    """
    spark = t.country.sparkSession
    root = root.rstrip("/")
    newest = _newest(spark, root)
    if newest is not None and not snapshot > newest:
        raise ValueError(f"snapshot {snapshot!r} does not sort after the published {newest!r}")
    attempt = f"{root}/data/{snapshot}-{uuid.uuid4().hex[:12]}"
    paths: dict[str, str] = {}
    for name in TABLE_NAMES:
        df = t.table(name)
        if base is not None and base_paths and df is base.table(name) and name in base_paths:
            paths[name] = base_paths[name]
            continue
        path = f"{attempt}/{name}"
        df.select(*SCHEMAS[name].fieldNames()).write.mode("errorifexists").parquet(path)
        paths[name] = path
    rows = [(snapshot, name, path) for name, path in paths.items()]
    (spark.createDataFrame(rows, "snapshot STRING, table_name STRING, path STRING")
     .coalesce(1).write.mode("errorifexists").json(f"{root}/{MANIFESTS}/{snapshot}"))
    return paths


def _newest(spark: SparkSession, root: str) -> str | None:
    """The newest published snapshot, None before the first one."""
    try:
        m = (spark.read.schema("snapshot STRING").option("recursiveFileLookup", "true")
             .json(f"{root}/{MANIFESTS}"))
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return m.agg(F.max("snapshot")).first()[0]


def _invoice_sums(t: RetailTables, invoices: DataFrame) -> DataFrame:
    """(invoice_id, amount) of each requested invoice, NULL without a sum in NUMERIC(12,2)."""
    wanted = invoices.select("invoice_id").distinct()
    totals = (t.invoice_line.join(wanted, "invoice_id", "left_semi").groupBy("invoice_id")
              .agg(F.sum("line_total").try_cast("decimal(12,2)").alias("amount")))
    return wanted.join(totals, "invoice_id", "left")


def payments_from_totals(t: RetailTables, invoices: DataFrame, method: str,
                         paid_at: datetime, ref_prefix: str = "PAY-") -> DataFrame:
    """One payment per requested invoice for the sum of its lines, in one aggregation
    rather than one subquery per invoice.  ``payment.amount`` is NOT NULL, so an invoice
    without lines (or with a sum out of range) gets none: ``payments_from_totals_rejected``
    lists it.  Ids continue after the current maximum in invoice order.
    """
    start = F.coalesce(t.payment.agg(F.max("payment_id")).scalar(), F.lit(0))
    rows = _invoice_sums(t, invoices).filter(F.col("amount").isNotNull()).select(
        "invoice_id", F.lit(method).alias("method"), "amount", ntz(paid_at).alias("paid_at"),
        F.concat(F.lit(ref_prefix), F.col("invoice_id").cast("string")).alias("external_ref"))
    return assign_keys(rows, "payment_id", ["invoice_id"], start).select(
        *SCHEMAS["payment"].fieldNames())


def payments_from_totals_rejected(t: RetailTables, invoices: DataFrame) -> DataFrame:
    """(invoice_id, reason) of the requested invoices that get no payment."""
    return (_invoice_sums(t, invoices).filter(F.col("amount").isNull())
            .select("invoice_id", F.lit("no lines or total out of range").alias("reason")))
