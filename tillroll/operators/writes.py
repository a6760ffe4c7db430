"""Batch write operators: (tables, parameters) -> new snapshot + affected rows.

Parquet tables take no UPDATE or DELETE, and a batch job should not mutate
what it reads, so every operator is a pure function returning a
:class:`Written` — the new :class:`RetailTables` (unchanged tables are
shared), the affected rows (what ``RETURNING`` gave) and, where requests can
be refused, the rejected requests with a reason.  Publishing the new snapshot
is a separate step (``tillroll.sources.tables.write_snapshot``).

NULL logic follows SQL: a row whose condition is NULL is not updated or
deleted (``coalesce(cond, false)``), and it is kept by the complementary filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import MONEY_TYPE, money_sum
from tillroll.functions.times import ntz
from tillroll.functions.sequence import assign_keys, running_sum
from tillroll.sources.schema import RetailTables
from tillroll.sources.starmap import category_id


@dataclass(frozen=True)
class Written:
    tables: RetailTables
    affected: DataFrame
    rejected: DataFrame | None = None


MAX_MONEY = Decimal("9999999999.99")  # largest NUMERIC(12,2)


def _holds(cond: Column) -> Column:
    """True only where ``cond`` is true (NULL counts as not matching)."""
    return F.coalesce(cond, F.lit(False))


def _ts(value) -> Column:
    return ntz(value)


def _max_id(df: DataFrame, col: str) -> Column:
    """Current maximum id as a scalar subquery (0 for an empty table)."""
    return F.coalesce(df.agg(F.max(col)).scalar(), F.lit(0)).cast("bigint")


# ---------------------------------------------------------------------------
# W1 mark_shipped

def mark_shipped(t: RetailTables, as_of: datetime, days: int = 7) -> Written:
    """PAID invoices dated strictly before ``as_of - days`` become SHIPPED."""
    cutoff = _ts(as_of - timedelta(days=days))
    due = (F.col("status") == "PAID") & (F.col("invoice_date") < cutoff)  # a filter drops NULL by itself
    new_invoice = t.invoice.withColumn(
        "status", F.when(_holds(due), F.lit("SHIPPED")).otherwise(F.col("status")))
    affected = t.invoices().filter(due).select("invoice_id", F.lit("SHIPPED").alias("status"))
    return Written(t.with_tables(invoice=new_invoice), affected)


# ---------------------------------------------------------------------------
# W2 add_categories

def add_categories(t: RetailTables, rows: DataFrame) -> Written:
    """Insert (name, description) rows into ``category``.

    A name that is NULL, already present, or given more than once in the
    batch is rejected (the UNIQUE / NOT NULL constraints); a blank name is a name.  The new id is
    derived from the name exactly as for existing categories; a clash with an
    existing id is rejected too.
    """
    named = rows.select("name", "description")
    counts = (named.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
              .withColumnRenamed("name", "_counted"))
    existing_names = t.category.select("name")
    existing_ids = t.category.select("category_id")
    staged = (named.join(counts, F.col("name").eqNullSafe(F.col("_counted")), "left")
              .drop("_counted")
              .withColumn("category_id", category_id(F.col("name")))
              .join(existing_names.withColumn("_exists", F.lit(True)), "name", "left")
              .join(existing_ids.withColumn("_id_taken", F.lit(True)), "category_id", "left"))
    reason = (F.when(F.col("name").isNull(), "missing name")
              .when(F.col("_exists"), "name already exists")
              .when(F.col("_n") > 1, "name repeated in batch")
              .when(F.col("_id_taken"), "id collision"))
    staged = staged.withColumn("reason", reason)
    accepted = staged.filter(F.col("reason").isNull()).select("category_id", "name", "description")
    rejected = staged.filter(F.col("reason").isNotNull()).select("name", "description", "reason")
    return Written(t.with_tables(category=t.category.unionByName(accepted)), accepted, rejected)


# ---------------------------------------------------------------------------
# W3 / W4 bridge maintenance

def _resolve_pairs(t: RetailTables, pairs: DataFrame) -> DataFrame:
    """(sku, category) pairs -> (sku, category, product_id, category_id); unknown -> NULL."""
    products = t.product.select("sku", "product_id")
    cats = t.category.select(F.col("name").alias("category"), "category_id")
    return (pairs.select("sku", "category").distinct()
            .join(products, "sku", "left").join(cats, "category", "left"))


def map_products(t: RetailTables, pairs: DataFrame) -> Written:
    """INSERT bridge rows for (sku, category name) pairs.

    An unknown sku inserts nothing (the INSERT ... SELECT finds no product); an
    unknown category or an existing mapping is rejected.  Repeated pairs in the
    batch count once.
    """
    resolved = _resolve_pairs(t, pairs)
    bridge = t.product_category.select("product_id", "category_id").withColumn("_mapped", F.lit(True))
    staged = (resolved.filter(F.col("product_id").isNotNull())
              .join(bridge, ["product_id", "category_id"], "left"))
    reason = (F.when(F.col("category_id").isNull(), "unknown category")
              .when(F.col("_mapped"), "already mapped"))
    staged = staged.withColumn("reason", reason)
    accepted = staged.filter(F.col("reason").isNull()).select("product_id", "category_id")
    rejected = staged.filter(F.col("reason").isNotNull()).select("sku", "category", "reason")
    new_bridge = t.product_category.unionByName(accepted)
    return Written(t.with_tables(product_category=new_bridge), accepted, rejected)


def unmap_products(t: RetailTables, pairs: DataFrame) -> Written:
    """DELETE bridge rows for (sku, category name) pairs; unknown names delete nothing."""
    targets = (_resolve_pairs(t, pairs)
               .filter(F.col("product_id").isNotNull() & F.col("category_id").isNotNull())
               .select("product_id", "category_id").distinct())
    removed = t.product_category.join(targets, ["product_id", "category_id"], "left_semi")
    kept = t.product_category.join(targets, ["product_id", "category_id"], "left_anti")
    return Written(t.with_tables(product_category=kept), removed)


# ---------------------------------------------------------------------------
# W5 reprice_category

def reprice_category(t: RetailTables, category: str, factor=Decimal("1.10")) -> Written:
    """unit_price = ROUND(unit_price * factor, 2) for products in ``category``.

    Invoice lines keep the price they were sold at.  The product set is a
    de-duplicated key set (the IN subquery), so a product is repriced once even
    if it reaches the category twice.
    """
    cat_ids = t.category.filter(F.col("name") == category).select("category_id")
    targets = (t.product_category.join(cat_ids, "category_id", "left_semi")
               .select("product_id").distinct().withColumn("_hit", F.lit(True)))
    new_price = F.round(F.col("unit_price") * F.lit(Decimal(str(factor))), 2).cast(MONEY_TYPE)
    staged = t.product.join(targets, "product_id", "left")
    new_product = staged.select(*[
        (F.when(_holds(F.col("_hit")), new_price).otherwise(F.col("unit_price")).alias(c)
         if c == "unit_price" else F.col(c)) for c in t.product.columns])
    affected = (t.product.join(targets, "product_id", "left_semi")
                .select("product_id", new_price.alias("unit_price")))
    return Written(t.with_tables(product=new_product), affected)


# ---------------------------------------------------------------------------
# W6 purge_small_refunds

def purge_small_refunds(t: RetailTables, limit=Decimal("1")) -> Written:
    """DELETE payments with amount < 0 and ABS(amount) < ``limit``; return them."""
    bound = F.lit(Decimal(str(limit)))  # abs(amount) < bound, as ranges that a scan can prune by
    small = (F.col("amount") < 0) & (F.col("amount") > -bound)
    removed = t.payment.filter(small).select("payment_id", "amount")
    kept = t.payment.filter(~_holds(small))
    return Written(t.with_tables(payment=kept), removed)


# ---------------------------------------------------------------------------
# requests that were applied before

def _replayed(requests: DataFrame, applied: DataFrame | None) -> tuple[DataFrame, Column]:
    """(the requests, why one can't be applied by its id alone).

    ``applied`` is the ledger: a table with the request_id of all that former batches applied.  It grows with the history, so it
    is cut to the batch's ids before it is joined.  Without a ledger ids aren't looked at.
    """
    if applied is None:
        return requests, F.lit(None).cast("string")
    ids = requests.select("request_id").filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.count(F.lit(1)).alias("_times"))
    done = applied.select("request_id").join(ids, "request_id", "left_semi").distinct().withColumn("_applied", F.lit(True))
    told = requests.join(ids.join(done, "request_id", "left").filter((F.col("_times") > 1) | F.col("_applied")), "request_id", "left")
    return told, (F.when(F.col("request_id").isNull(), "missing request id").when(F.col("_applied"), "already applied")
                  .when(F.col("_times") > 1, "request repeated in batch"))


# ---------------------------------------------------------------------------
# W7 place_orders

def _whole(col: Column) -> Column:
    """A bigint if the value, given as a number or a text, is a whole number; else NULL."""
    number = col.try_cast("decimal(30,6)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


class PlacedOrders:
    """The outputs of ``place_orders``, each built when it is first asked for.

    ``rejected`` needs no numbering; invoices, lines and payments share one
    numbering of the orders, which writes a checkpoint.  ``tables`` are lazy
    unions; to publish a batch, append ``invoices``, ``lines`` and ``payments``
    instead of rewriting whole tables.
    """

    def __init__(self, t: RetailTables, staged: DataFrame, orders: DataFrame, methods: DataFrame, when: Column):
        self._t, self._staged, self._orders, self._methods, self._when = t, staged, orders, methods, when

    @cached_property
    def _placed(self) -> DataFrame:
        good = self._orders.filter(F.col("_order_reason").isNull())
        return assign_keys(good, "invoice_id", ["customer_id", "order_id"], _max_id(self._t.invoices(), "invoice_id"))

    @cached_property
    def invoices(self) -> DataFrame:
        countries = self._t.country.select("country_id", F.col("name").alias("ship_to_country"))
        return (self._placed.join(countries, "country_id", "left")
                .select("invoice_id", "customer_id", self._when.alias("invoice_date"), F.lit("PAID").alias("status"),
                        F.lit("GBP").alias("currency"), "ship_to_country"))

    @cached_property
    def _numbered_lines(self) -> DataFrame:
        good = self._staged.filter(F.col("reason").isNull()).drop("customer_id")
        return assign_keys(good.join(self._placed.select("order_id", "invoice_id"), "order_id"),
                           "invoice_line_id", ["invoice_id", "request_id"], _max_id(self._t.invoice_line, "invoice_line_id"))

    @cached_property
    def lines(self) -> DataFrame:
        return self._numbered_lines.select("invoice_line_id", "invoice_id", F.col("_product").alias("product_id"),
                            F.col("_quantity").cast("int").alias("quantity"), F.col("_price").alias("unit_price"), "line_total")

    @cached_property
    def payments(self) -> DataFrame:
        first = _max_id(self._t.invoices(), "invoice_id")
        return self._placed.join(self._methods, "order_id", "left").select(
            (_max_id(self._t.payment, "payment_id") + F.col("invoice_id") - first).alias("payment_id"), "invoice_id",
            F.coalesce("_method", F.lit("CARD")).alias("method"), F.col("subtotal").cast(MONEY_TYPE).alias("amount"),
            self._when.alias("paid_at"), F.lit(None).cast("string").alias("external_ref"))

    @cached_property
    def ledger(self) -> DataFrame:
        """(request_id, invoice_id) of the lines that were billed, to be appended to the ledger with the batch."""
        return self._numbered_lines.select("request_id", "invoice_id")

    @cached_property
    def rejected(self) -> DataFrame:
        refused = self._orders.filter(F.col("_order_reason").isNotNull()).select("order_id", "_order_reason")
        columns = ["request_id", "order_id", "customer_id", "product_id", "quantity", "reason"]
        return (self._staged.join(refused, "order_id", "left")
                .withColumn("reason", F.coalesce("reason", "_order_reason"))
                .filter(F.col("reason").isNotNull()).select(*columns))

    @cached_property
    def tables(self) -> RetailTables:
        t = self._t
        return t.with_tables(invoice=t.invoice.unionByName(self.invoices),
                             invoice_line=t.invoice_line.unionByName(self.lines),
                             payment=t.payment.unionByName(self.payments))


def place_orders(t: RetailTables, requests: DataFrame, as_of: datetime, applied: DataFrame | None = None) -> PlacedOrders:
    """Turn order requests into invoices, lines and one payment per invoice.

    ``requests``: (request_id, order_id, customer_id, product_id, quantity,
    method), one row per line; product and quantity may be texts as typed in.
    Rules of the console flow, applied to the whole batch:

    * a line needs an order id and an existing customer, a whole quantity > 0
      and an existing, active product, else that line alone is refused; a
      repeated product gives separate lines;
    * the price is the product's current price; line_total = quantity * price;
    * an order whose lines name two customers or two payment methods is refused;
      blank methods count as none, upper and lower case as one;
    * an order whose accepted lines sum to 0 (only free products) is cancelled:
      no invoice, its lines are rejected;
    * invoice: status PAID, currency GBP, date ``as_of``, ship-to = name of the
      customer's country (NULL without one);
    * payment: the order's method upper-cased and trimmed, else CARD, amount = subtotal;
    * with ``applied`` (a ledger of request ids, see ``PlacedOrders.ledger``), lines that were billed before are refused, as
      are lines without an id or with one that the batch repeats: a batch that is sent twice bills once.

    Ids continue after the current maxima: invoices in (customer_id, order_id)
    order, lines in (invoice_id, request_id) order, and payment i belongs to
    the i-th new invoice.  Nothing runs before an output is asked for.
    """
    requests, id_reason = _replayed(requests.select("request_id", "order_id", "customer_id", "product_id", "quantity", "method"), applied)
    req = (requests.select("request_id", F.col("order_id").cast("string").alias("order_id"), "customer_id", "product_id", "quantity", "method",
                           id_reason.alias("_id_reason"))
           .withColumn("_product", F.col("product_id").try_cast("bigint")).withColumn("_quantity", _whole(F.col("quantity"))))
    known = t.customer.select("customer_id", "country_id").withColumn("_known", F.lit(True))
    priced = t.product.filter(F.col("is_active")).select(F.col("product_id").alias("_product"), F.col("unit_price").alias("_price"))
    staged = req.join(known, "customer_id", "left").join(priced, "_product", "left")
    line_reason = (F.when(F.col("_id_reason").isNotNull(), F.col("_id_reason"))
                   .when(F.col("order_id").isNull(), "missing order id")
                   .when(~_holds(F.col("_known")), "unknown customer")
                   .when(F.col("_product").isNull(), "invalid product id")
                   .when(~_holds(F.col("_quantity") > 0), "invalid quantity")
                   .when(F.col("_price").isNull(), "unknown or inactive product"))
    # NUMERIC(12,2) and INTEGER overflow refuse the line instead of failing the batch.
    line_total = F.when(F.col("_quantity") <= 2147483647,
                        (F.col("_quantity").cast("decimal(20,0)") * F.col("_price")).try_cast(MONEY_TYPE))
    staged = (staged.withColumn("line_total", line_total)
              .withColumn("reason", F.coalesce(line_reason, F.when(
                  F.col("line_total").isNull(), F.lit("line total out of range")))))

    ok = F.col("reason").isNull()
    method = F.upper(F.trim(F.col("method")))
    methods = staged.select("order_id", method.alias("_method")).filter((F.col("_method") != "") & F.col("order_id").isNotNull()).distinct()
    several = methods.groupBy("order_id").agg(F.count(F.lit(1)).alias("_methods")).filter(F.col("_methods") > 1)
    orders = (staged.filter(F.col("order_id").isNotNull()).groupBy("order_id")
              .agg(money_sum(F.when(ok, F.col("line_total"))).alias("subtotal"), F.max(F.when(ok, F.col("country_id"))).alias("country_id"),
                   F.min("customer_id").alias("customer_id"), F.max("customer_id").alias("_other_customer"))
              .filter(F.col("subtotal").isNotNull())  # without an accepted line there is no order
              .join(several, "order_id", "left"))
    order_reason = (F.when(F.col("customer_id") != F.col("_other_customer"), "customers disagree")
                    .when(F.col("_methods") > 1, "payment methods disagree")
                    .when(~_holds(F.col("subtotal") > 0), "order total is zero")
                    .when(F.col("subtotal") > F.lit(MAX_MONEY), "order total out of range"))
    return PlacedOrders(t, staged, orders.withColumn("_order_reason", order_reason), methods, _ts(as_of))


# ---------------------------------------------------------------------------
# W9 record_refunds

class RecordedRefunds:
    """The outputs of ``record_refunds``; ``rejected`` runs without the numbering of the others."""

    def __init__(self, t: RetailTables, staged: DataFrame, when: Column):
        self._t, self._staged, self._when = t, staged, when

    @cached_property
    def rejected(self) -> DataFrame:
        return self._staged.filter(F.col("reason").isNotNull()).select(
            "request_id", "invoice_id", F.col("amount").cast("string").alias("amount"), "reason")

    @cached_property
    def _numbered(self) -> DataFrame:
        good = self._staged.filter(F.col("reason").isNull()).drop("amount")
        paid = (self._t.payment.join(good.select("invoice_id").distinct(), "invoice_id", "left_semi")
                .groupBy("invoice_id").agg(money_sum("amount").alias("_paid")))
        good = running_sum(good, ["invoice_id"], ["request_id"], F.col("refund"), "_refunded_upto")
        good = (good.join(paid, "invoice_id", "left")
                .withColumn("_paid_before", F.coalesce("_paid", F.lit(0).cast("decimal(38,2)"))
                            - (F.col("_refunded_upto") - F.col("refund"))))
        return assign_keys(good, "payment_id", ["request_id"], _max_id(self._t.payment, "payment_id"))

    @cached_property
    def payments(self) -> DataFrame:
        return self._numbered.select(
            "payment_id", "invoice_id", F.lit("REFUND").alias("method"), (-F.col("refund")).cast(MONEY_TYPE).alias("amount"),
            self._when.alias("paid_at"), F.lit(None).cast("string").alias("external_ref"))

    @cached_property
    def affected(self) -> DataFrame:
        return self._numbered.select(
            "request_id", "payment_id", "invoice_id", (-F.col("refund")).cast(MONEY_TYPE).alias("amount"),
            (F.col("refund") > F.col("_paid_before")).alias("over_refund"))

    @cached_property
    def ledger(self) -> DataFrame:
        """(request_id, payment_id) of the refunds that were paid, to be appended to the ledger with the batch."""
        return self._numbered.select("request_id", "payment_id")

    @cached_property
    def tables(self) -> RetailTables:
        return self._t.with_tables(payment=self._t.payment.unionByName(self.payments))


def record_refunds(t: RetailTables, refunds: DataFrame, as_of: datetime, applied: DataFrame | None = None) -> RecordedRefunds:
    """Append a REFUND payment of -amount for each valid refund request.

    ``refunds``: (request_id, invoice_id, amount).  The amount, a number or a
    text, must be a finite number that is > 0 in cents and fits NUMERIC(12,2),
    and the invoice must exist.  The status of the invoice is not changed.  A
    refund larger than what was paid so far is accepted with ``over_refund`` =
    true — "so far" includes the earlier accepted refunds of the same invoice
    in this batch (request order), as if they had been entered one after another.
    With ``applied``, a ledger of request ids, refunds that were paid before, have no id or repeat one are refused.
    """
    refunds, id_reason = _replayed(refunds.select("request_id", "invoice_id", "amount"), applied)
    req = (refunds.select("request_id", "invoice_id", "amount", id_reason.alias("_id_reason"))
           .withColumn("refund", F.col("amount").try_cast(MONEY_TYPE)))
    known = (t.invoices().select("invoice_id").join(req.select("invoice_id").distinct(), "invoice_id", "left_semi")
             .withColumn("_known", F.lit(True)))
    staged = req.join(known, "invoice_id", "left")
    reason = (F.when(F.col("_id_reason").isNotNull(), F.col("_id_reason"))
              .when(~_holds(F.col("refund") > 0), "invalid amount")
              .when(~_holds(F.col("_known")), "unknown invoice"))
    return RecordedRefunds(t, staged.withColumn("reason", reason), _ts(as_of))
