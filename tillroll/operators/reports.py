"""Report operators (read only).  Each returns a lazy DataFrame.

Plan shape used throughout: the fact tables (invoice_line, payment) are
aggregated to one row per join key *before* they meet a dimension, so the
shuffle after the partial aggregate carries one row per key and map task
instead of one row per line, and a key holding a large share of the lines
(a hot invoice, product or customer) collapses during the map-side combine.
The aggregate's output is hash-partitioned on the key, so the following
join reuses that partitioning instead of shuffling the big side again.
Dimension joins are left to the planner: AQE broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``.

Final ``orderBy`` calls are presentation (a distributed range sort); every
one ends with a unique tie-break so the order is total.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.money import (avg_money, cents, money_sum, percent_of,
                                      to_total)
from tillroll.functions.times import ntz, truncate
from tillroll.plans.session import ensure_checkpoint_dir
from tillroll.sources.layouts import range_of
from tillroll.sources.schema import RetailTables


def _ts(value: datetime | str | None) -> Column | None:
    return None if value is None else ntz(value)


def _invoices_since(t: RetailTables, since) -> DataFrame:
    inv = t.invoices()
    if since is not None:
        inv = inv.filter(F.col("invoice_date") >= _ts(since))
    return inv


# ---------------------------------------------------------------------------
# shared pre-aggregates

def invoice_totals(t: RetailTables) -> DataFrame:
    """(invoice_id, total): SUM(line_total) per invoice id that has lines."""
    return t.invoice_line.groupBy("invoice_id").agg(money_sum("line_total").alias("total"))


def _of_known_invoices(t: RetailTables, per_invoice: DataFrame) -> DataFrame:
    """Only ids in the invoice table (Parquet enforces no foreign key); the aggregate's
    partitioning by invoice_id serves this join too."""
    return per_invoice.join(t.invoices().select("invoice_id"), "invoice_id", "left_semi")


def customer_revenue(t: RetailTables, with_stats: bool = False) -> DataFrame:
    """(customer_id, revenue[, n_invoices]) over invoices that have lines."""
    per_invoice = invoice_totals(t).join(t.invoices().select("invoice_id", "customer_id"),
                                         "invoice_id")
    aggs = [money_sum("total").alias("revenue")]
    if with_stats:
        aggs.append(F.count(F.lit(1)).alias("n_invoices"))
    return per_invoice.groupBy("customer_id").agg(*aggs)


def _named_revenue(t: RetailTables) -> DataFrame:
    """(full_name, revenue): revenue merged over customers sharing a name."""
    return (customer_revenue(t)
            .join(t.customer.select("customer_id", "full_name"), "customer_id")
            .groupBy("full_name").agg(money_sum("revenue").alias("revenue")))


def category_revenue(t: RetailTables) -> DataFrame:
    """(category, revenue); a product in k categories counts k times."""
    per_product = t.invoice_line.groupBy("product_id").agg(money_sum("line_total").alias("revenue"))
    per_category = (per_product.join(t.product_category.select("product_id", "category_id"),
                                     "product_id")
                    .groupBy("category_id").agg(money_sum("revenue").alias("revenue")))
    return (per_category.join(t.category.select("category_id", F.col("name").alias("category")),
                              "category_id")
            .groupBy("category").agg(money_sum("revenue").alias("revenue")))


# ---------------------------------------------------------------------------
# R1 .. R25

def browse_products(t: RetailTables) -> DataFrame:
    """Active products, by id."""
    return (t.product.filter(F.col("is_active"))
            .select("product_id", "sku", "name", "unit_price", "is_active")
            .orderBy("product_id"))


def best_selling(t: RetailTables) -> DataFrame:
    """R2: units and sales per (sku, name); most units first, then most sales."""
    per_product = t.invoice_line.groupBy("product_id").agg(
        F.sum("quantity").alias("units"), money_sum("line_total").alias("sales"))
    return (t.product.select("product_id", "sku", "name")
            .join(per_product, "product_id")
            .groupBy("sku", "name")
            .agg(F.sum("units").cast("bigint").alias("units"), money_sum("sales").alias("sales"))
            .orderBy(F.desc("units"), F.desc("sales"), "sku", "name"))


def revenue_by_country(t: RetailTables) -> DataFrame:
    """Line revenue per country of the invoicing customer (gross of refunds)."""
    return (customer_revenue(t)
            .join(t.customer.select("customer_id", "country_id"), "customer_id")
            .join(t.country.select("country_id", F.col("name").alias("country")), "country_id")
            .groupBy("country").agg(money_sum("revenue").alias("revenue"))
            .orderBy(F.desc("revenue"), "country"))


def net_profit(t: RetailTables) -> DataFrame:
    """Sum of all payments including refunds; exactly one row."""
    return t.payment.agg(
        F.coalesce(money_sum("amount"), F.lit(0).cast("decimal(38,2)")).alias("net_profit"))


def customers_short(t: RetailTables) -> DataFrame:
    """Id and name of every customer."""
    return t.customer.select("customer_id", "full_name").orderBy("customer_id")


def revenue_by_category(t: RetailTables) -> DataFrame:
    """Category revenue with N:M fan-out; uncategorised products vanish."""
    return category_revenue(t).orderBy(F.desc("revenue"), "category")


def orders_per_customer(t: RetailTables) -> DataFrame:
    """Invoice count per full name (customers without invoices are absent)."""
    per_customer = t.invoices().groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return (per_customer.join(t.customer.select("customer_id", "full_name"), "customer_id")
            .groupBy("full_name").agg(F.sum("n").cast("bigint").alias("orders"))
            .orderBy(F.desc("orders"), "full_name"))


def avg_order_value(t: RetailTables) -> DataFrame:
    """ROUND(AVG(invoice total), 2) per full name, exact half-up on cents."""
    stats = (customer_revenue(t, with_stats=True)
             .join(t.customer.select("customer_id", "full_name"), "customer_id")
             .groupBy("full_name")
             .agg(money_sum("revenue").alias("s"), F.sum("n_invoices").alias("n")))
    # exact: the decimal sum is converted to cents once per name, not per invoice
    return (stats.select("full_name", avg_money(cents("s"), F.col("n")).alias("avg_order_value"))
            .orderBy(F.desc("avg_order_value"), "full_name"))


def monthly_revenue(t: RetailTables, grain: str = "month") -> DataFrame:
    """Line revenue per calendar month of the invoice date (empty months absent)."""
    month = truncate(F.col("invoice_date"), grain)
    return (invoice_totals(t)
            .join(t.invoices().select("invoice_id", "invoice_date"), "invoice_id")
            .groupBy(month.alias(grain)).agg(money_sum("total").alias("revenue"))
            .orderBy(grain))


def customers_without_orders(t: RetailTables, since=None) -> DataFrame:
    """Customers with no invoice (dated on/after ``since`` when given)."""
    buyers = _invoices_since(t, since).select("customer_id").distinct()
    return (t.customer.join(buyers, "customer_id", "left_anti")
            .select("full_name", "email"))


def products_never_ordered(t: RetailTables, since=None) -> DataFrame:
    """Products on no invoice line (of an invoice dated on/after ``since``)."""
    lines = t.invoice_line.select("invoice_id", "product_id")
    if since is not None:
        lines = lines.join(_invoices_since(t, since).select("invoice_id"), "invoice_id",
                           "left_semi")
    ordered = lines.select("product_id").distinct()
    return t.product.join(ordered, "product_id", "left_anti").select("sku", "name")


def top_customers(t: RetailTables, n: int = 3, ties: str = "cut") -> DataFrame:
    """Revenue per customer id, ranked.

    ``cut``: exactly the first ``n`` rows by revenue (ties broken by
    customer_id), ranked among themselves — the rank of each kept row equals its
    global rank because every higher-revenue row is kept too.  The limit runs
    first (TakeOrderedAndProject keeps n rows per task), so the window sees n rows.
    ``keep``: every customer whose RANK() <= n, however many tie at the cut.
    The customer totals are computed once and checkpointed (three reads).
    The n-th revenue (from the same bounded top-n) is the threshold; rows at or
    above it are kept by a distributed filter, and each keeps the rank of its
    revenue level, 1 + the rows at higher levels.  There are at most n distinct
    levels, so only that small table is windowed and broadcast.  (A NULL
    revenue cannot arise from NOT NULL line totals and is not ranked.)
    """
    revenue = (customer_revenue(t)
               .join(t.customer.select("customer_id", "full_name"), "customer_id"))
    by_revenue = Window.orderBy(F.desc("revenue"))
    if ties == "cut":
        ranked = (revenue.orderBy(F.desc("revenue"), "customer_id").limit(n)
                  .withColumn("rnk", F.rank().over(by_revenue)))
    elif ties == "keep":
        # three uses of the per-customer totals: aggregate the lines once and
        # keep the (much smaller) result in the reliable checkpoint folder
        ensure_checkpoint_dir(revenue.sparkSession)
        valued = revenue.filter(F.col("revenue").isNotNull()).checkpoint(eager=True)
        threshold = (valued.orderBy(F.desc("revenue"), "customer_id").limit(n)
                     .agg(F.min("revenue")).scalar())
        kept = valued.filter(F.col("revenue") >= threshold)
        higher = by_revenue.rowsBetween(Window.unboundedPreceding, -1)
        levels = (kept.groupBy("revenue").agg(F.count(F.lit(1)).alias("_rows"))
                  .select("revenue", (F.coalesce(F.sum("_rows").over(higher), F.lit(0)) + 1)
                          .cast("int").alias("rnk")))
        ranked = kept.join(F.broadcast(levels), "revenue")
    else:
        raise ValueError(f"ties must be 'cut' or 'keep', not {ties!r}")
    return ranked.select("full_name", "revenue", "rnk").orderBy("rnk", "full_name")


def partial_refunds(t: RetailTables, literal: bool = False) -> DataFrame:
    """Invoices whose payments (refunds included) are below their lines.

    Each side is aggregated per invoice before the join, so an invoice with L
    lines and P payments is compared as SUM(payments) < SUM(lines).  Invoices
    without any payment are excluded (inner join), as in the reference text.
    Orphan lines and payments, of no known invoice, don't count.

    ``literal=True`` (R13b) reproduces the reference query as written, which
    joins lines to payments first and so sums every line P times and every
    payment L times.  The same numbers come from the per-invoice sums and
    counts — P * SUM(lines) and L * SUM(payments) — without forming the L*P pairs.
    """
    lines = t.invoice_line.groupBy("invoice_id").agg(
        money_sum("line_total").alias("billed"), F.count(F.lit(1)).alias("n_lines"))
    pays = t.payment.groupBy("invoice_id").agg(
        money_sum("amount").alias("paid"), F.count(F.lit(1)).alias("n_payments"))
    joined = lines.join(pays, "invoice_id")
    if literal:
        billed = to_total(F.col("billed") * F.col("n_payments"))
        paid = to_total(F.col("paid") * F.col("n_lines"))
    else:
        billed, paid = F.col("billed"), F.col("paid")
    # few invoices pass, so orphans go last
    return _of_known_invoices(t, joined.select("invoice_id", billed.alias("billed"), paid.alias("paid"))
                              .filter(F.col("paid") < F.col("billed")))


def last_order(t: RetailTables, since=None) -> DataFrame:
    """Latest invoice date per full name; customers without one get NULL (last)."""
    latest = (_invoices_since(t, since).groupBy("customer_id")
              .agg(F.max("invoice_date").alias("last_order")))
    return (t.customer.select("customer_id", "full_name")
            .join(latest, "customer_id", "left")
            .groupBy("full_name").agg(F.max("last_order").alias("last_order"))
            .orderBy(F.asc_nulls_last("last_order"), "full_name"))


def buyers_of_category(t: RetailTables, category: str, since=None) -> DataFrame:
    """Distinct names of customers with an invoice line in ``category``.

    The correlated EXISTS becomes a chain of semi joins on de-duplicated key
    sets: category -> products -> invoices -> customers.
    """
    cat_ids = t.category.filter(F.col("name") == category).select("category_id")
    products = (t.product_category.join(cat_ids, "category_id", "left_semi")
                .select("product_id").distinct())
    invoices = (t.invoice_line.select("invoice_id", "product_id")
                .join(products, "product_id", "left_semi").select("invoice_id").distinct())
    customers = (_invoices_since(t, since).select("invoice_id", "customer_id")
                 .join(invoices, "invoice_id", "left_semi").select("customer_id").distinct())
    return (t.customer.join(customers, "customer_id", "left_semi")
            .select("full_name").distinct())


def invoices_above_average(t: RetailTables) -> DataFrame:
    """Invoices whose total exceeds the mean invoice total.

    ``total > SUM/n`` is tested as ``total * n > SUM``, exact in decimals (no
    average is ever rounded); SUM and n come from one global aggregate used as
    a scalar subquery.
    """
    # both uses of the totals read them from the checkpoint folder: the lines are aggregated once
    totals = _of_known_invoices(t, invoice_totals(t))
    ensure_checkpoint_dir(totals.sparkSession)
    totals = totals.checkpoint(eager=True)
    stats = totals.agg(F.struct(money_sum("total").alias("s"),
                                F.count(F.lit(1)).alias("n")).alias("st")).scalar()
    return (totals.withColumn("st", stats)
            .filter(F.col("total") * F.col("st.n") > F.col("st.s"))
            .select("invoice_id", "total")
            .orderBy(F.desc("total"), "invoice_id"))


def search_products(t: RetailTables, keyword: str) -> DataFrame:
    """Case-insensitive substring match on the product name (LIKE semantics:
    ``%`` and ``_`` inside the keyword act as wildcards, as in the reference)."""
    pattern = F.concat(F.lit("%"), F.lower(F.lit(keyword)), F.lit("%"))
    return t.product.filter(F.like(F.lower(F.col("name")), pattern)).select("sku", "name")


def customers_min_revenue(t: RetailTables, threshold) -> DataFrame:
    """Names whose total line revenue is >= ``threshold``."""
    limit = F.lit(Decimal(str(threshold))).cast("decimal(38,2)")
    return (_named_revenue(t).filter(F.col("revenue") >= limit)
            .orderBy(F.desc("revenue"), "full_name"))


def category_share(t: RetailTables) -> DataFrame:
    """Category revenue and its share of the (double-counted) grand total."""
    revenue = category_revenue(t)
    grand = revenue.agg(F.sum(cents("revenue")).alias("grand")).scalar()
    return (revenue.withColumn("grand", grand)
            .select("category", "revenue",
                    percent_of(cents("revenue"), F.col("grand")).alias("pct_of_total"))
            .orderBy(F.desc("revenue"), "category"))


def invoice_refund_flags(t: RetailTables) -> DataFrame:
    """Every invoice with its customer name and 'Y' if it has a negative payment.

    The flag is by the sign of the amount, never by the payment method.
    """
    refunded = (t.payment.filter(F.col("amount") < 0).select("invoice_id").distinct()
                .withColumn("refunded", F.lit(True)))
    return (t.invoices().select("invoice_id", "customer_id")
            .join(refunded, "invoice_id", "left")  # before the customers: tables bucketed by invoice need no exchange for it
            .join(t.customer.select("customer_id", "full_name"), "customer_id")
            .select("invoice_id", "full_name",
                    F.when(F.col("refunded"), F.lit("Y")).otherwise(F.lit("N")).alias("has_refund"))
            .orderBy("invoice_id"))


#: Requested ids that are broadcast at most.
MOST_IDS = 1 << 20


def _wanted(t: RetailTables, ids: DataFrame) -> tuple[DataFrame, list[str]]:
    """(the requested invoice ids, the columns to join them on).

    Tables partitioned by id ranges are joined on the range too: a broadcast of the ids then prunes the partitions that
    hold none of them (dynamic partition pruning).  More ids than that would leave few partitions out, and are shuffled.
    """
    wanted = ids.select("invoice_id").filter(F.col("invoice_id").isNotNull()).distinct()
    if t.range_width is None:
        return wanted, ["invoice_id"]
    ensure_checkpoint_dir(wanted.sparkSession)
    kept = wanted.select("invoice_id", range_of(F.col("invoice_id"), t.range_width).alias("invoice_range")).checkpoint(eager=True)
    few = kept.count() <= MOST_IDS
    # the planner prunes for a side that a comparison makes selective
    kept = kept.filter(F.col("invoice_range").between(-(2 ** 62), 2 ** 62))
    return F.broadcast(kept) if few else kept, ["invoice_id", "invoice_range"]


def invoice_header(t: RetailTables, ids: DataFrame) -> DataFrame:
    """Header of each requested invoice (unknown ids give no row)."""
    wanted, on = _wanted(t, ids)
    return (t.invoice.join(wanted, on, "left_semi")
            .join(t.customer.select("customer_id", "full_name"), "customer_id")
            .select("invoice_id", "full_name", "invoice_date", "status", "ship_to_country")
            .orderBy("invoice_id"))


def invoice_items(t: RetailTables, ids: DataFrame) -> DataFrame:
    """Product name, quantity, price and total of the lines of requested invoices."""
    wanted, on = _wanted(t, ids)
    return (t.invoice_line.join(wanted, on, "left_semi")
            .join(t.product.select("product_id", F.col("name").alias("product_name")), "product_id")
            .select("invoice_id", "product_name", "quantity", "unit_price", "line_total"))


def invoice_payments(t: RetailTables, ids: DataFrame) -> DataFrame:
    """Payments and refunds of requested invoices, by payment time."""
    wanted, on = _wanted(t, ids)
    return (t.payment.join(wanted, on, "left_semi")
            .orderBy("invoice_id", F.asc_nulls_last("paid_at"), "payment_id")
            .select("invoice_id", "method", "amount", "paid_at"))


def invoice_balance(t: RetailTables, ids: DataFrame) -> DataFrame:
    """Billed and paid so far per requested invoice, each 0 when absent."""
    zero, none = F.lit(0).cast("decimal(38,2)"), F.lit(None).cast("decimal(12,2)")
    wanted, on = _wanted(t, ids)
    if t.range_width is None:
        wanted = wanted.hint("shuffle_hash")  # a task holds its share of the ids and neither sorts lines nor payments
    # only the requested invoices' lines and payments are aggregated
    lines = t.invoice_line.join(wanted, on, "left_semi").select("invoice_id", F.col("line_total").alias("billed"), none.alias("paid"))
    payments = t.payment.join(wanted, on, "left_semi").select("invoice_id", none.alias("billed"), F.col("amount").alias("paid"))
    # a missing id is asked for as well, and has neither lines nor payments
    asked = ids.select("invoice_id", none.alias("billed"), none.alias("paid"))
    return (asked.unionByName(lines).unionByName(payments).groupBy("invoice_id")
            .agg(money_sum("billed").alias("billed"), money_sum("paid").alias("paid"))
            .select("invoice_id", F.coalesce("billed", zero).alias("billed"),
                    F.coalesce("paid", zero).alias("paid")))


def active_price(t: RetailTables, ids: DataFrame) -> DataFrame:
    """Current price of each requested product that exists and is active; ids may be
    texts as typed in, and those that are no number name no product."""
    wanted = ids.select(F.col("product_id").try_cast("bigint").alias("product_id")).distinct()
    return (t.product.filter(F.col("is_active"))
            .join(wanted, "product_id", "left_semi")
            .select("product_id", "unit_price"))
