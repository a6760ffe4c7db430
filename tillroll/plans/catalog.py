"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry maps the driver tables with ``load_star`` and runs one operator
over the whole tables with the parameters in ``oracle_sql.PARAMS``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tillroll.operators import partition_writes as PW
from tillroll.operators import quality as Q
from tillroll.operators import reports as R
from tillroll.operators import writes as W
from tillroll.plans.oracle_sql import PARAMS as P
from tillroll.plans.session import ensure_checkpoint_dir
from tillroll.sources.layouts import save_bucketed, save_for_updates, save_ranged, saved_once
from tillroll.sources.requests import (brand_pairs, inactive_type_pairs, load_order_requests,
                                       load_refund_requests, new_category_rows)
from tillroll.sources.starmap import load_star, raw_table
from tillroll.sources.tables import payments_from_totals, payments_from_totals_rejected

Query = Callable[[SparkSession, str], DataFrame]


def _day(s: str) -> datetime:
    return datetime.fromisoformat(s)


def _report(fn, *args, **kwargs) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_star(spark, sf_dir), *args, **kwargs)
    run.__name__ = fn.__name__
    return run


def _with_refund_ids(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_star(spark, sf_dir), load_refund_requests(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


def _with_order_products(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_star(spark, sf_dir), load_order_requests(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


REPORT_QUERIES: dict[str, Query] = {
    "browse_products": _report(R.browse_products),
    "best_selling_products": _report(R.best_selling),
    "revenue_by_country": _report(R.revenue_by_country),
    "total_net_profit": _report(R.net_profit),
    "customers_short": _report(R.customers_short),
    "revenue_by_category": _report(R.revenue_by_category),
    "orders_per_customer": _report(R.orders_per_customer),
    "avg_order_value": _report(R.avg_order_value),
    "monthly_revenue": _report(R.monthly_revenue),
    "customers_without_orders": _report(R.customers_without_orders),
    "customers_without_orders_since": _report(R.customers_without_orders, since=_day(P["customers_since"])),
    "products_never_ordered": _report(R.products_never_ordered),
    "products_never_ordered_since": _report(R.products_never_ordered, since=_day(P["products_since"])),
    "top_customers": _report(R.top_customers, n=3),
    "top_customers_with_ties": _report(R.top_customers, n=P["top_n_ties"], ties="keep"),
    "partial_refunds": _report(R.partial_refunds),
    "partial_refunds_fanout": _report(R.partial_refunds, literal=True),
    "last_order_per_customer": _report(R.last_order),
    "last_order_per_customer_since": _report(R.last_order, since=_day(P["last_order_since"])),
    "buyers_of_category": _report(R.buyers_of_category, P["buyers_category"]),
    "buyers_of_category_since": _report(R.buyers_of_category, P["buyers_category"], since=_day(P["buyers_since"])),
    "invoices_above_average": _report(R.invoices_above_average),
    "product_keyword_search": _report(R.search_products, P["keyword"]),
    "customers_min_revenue": _report(R.customers_min_revenue, Decimal(P["min_revenue"])),
    "category_revenue_share": _report(R.category_share),
    "invoice_refund_flags": _report(R.invoice_refund_flags),
    "invoice_header": _with_refund_ids(R.invoice_header),
    "invoice_items": _with_refund_ids(R.invoice_items),
    "invoice_payments": _with_refund_ids(R.invoice_payments),
    "invoice_balance": _with_refund_ids(R.invoice_balance),
    "active_price_lookup": _with_order_products(R.active_price),
}


def _saved(save, fn, *args) -> Query:
    """A report over the tables in a saved layout."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = saved_once(load_star(spark, sf_dir), (sf_dir.rstrip("/"),), save)
        return fn(t, *(make(spark, sf_dir) for make in args))
    run.__name__ = fn.__name__
    return run


LAYOUT_QUERIES: dict[str, Query] = {
    "invoice_header_ranged": _saved(save_ranged, R.invoice_header, load_refund_requests),
    "invoice_items_ranged": _saved(save_ranged, R.invoice_items, load_refund_requests),
    "invoice_payments_ranged": _saved(save_ranged, R.invoice_payments, load_refund_requests),
    "invoice_balance_ranged": _saved(save_ranged, R.invoice_balance, load_refund_requests),
    "revenue_by_country_bucketed": _saved(save_bucketed, R.revenue_by_country),
    "avg_order_value_bucketed": _saved(save_bucketed, R.avg_order_value),
    "partial_refunds_bucketed": _saved(save_bucketed, R.partial_refunds),
    "invoices_above_average_bucketed": _saved(save_bucketed, R.invoices_above_average),
    "invoice_refund_flags_bucketed": _saved(save_bucketed, R.invoice_refund_flags),
}


def _write(make, pick) -> Query:
    """A registered view of one output of a write operator."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pick(make(spark, sf_dir))
    return run


def _shipped(spark, sf_dir):
    return W.mark_shipped(load_star(spark, sf_dir), _day(P["ship_as_of"]), days=P["ship_days"])


def _categories_added(spark, sf_dir):
    return W.add_categories(load_star(spark, sf_dir),
                            new_category_rows(raw_table(spark, sf_dir, "part")))


def _brands_mapped(spark, sf_dir):
    # script order: the brand categories are added first, then mapped
    after = _categories_added(spark, sf_dir).tables
    return W.map_products(after, brand_pairs(raw_table(spark, sf_dir, "part")))


def _brands_mapped_again(spark, sf_dir):
    # the brands aren't categories yet, and the inactive products are mapped to their types already
    part = raw_table(spark, sf_dir, "part")
    t = load_star(spark, sf_dir)
    return W.map_products(t, brand_pairs(part).unionByName(inactive_type_pairs(part)))


def _inactive_unmapped(spark, sf_dir):
    return W.unmap_products(load_star(spark, sf_dir),
                            inactive_type_pairs(raw_table(spark, sf_dir, "part")))


def _repriced(spark, sf_dir):
    return W.reprice_category(load_star(spark, sf_dir), P["reprice_category"],
                              Decimal(P["reprice_factor"]))


def _purged(spark, sf_dir):
    return W.purge_small_refunds(load_star(spark, sf_dir), Decimal(P["purge_limit"]))


def _placed(spark, sf_dir):
    return W.place_orders(_free_products(spark, sf_dir), load_order_requests(spark, sf_dir), _day(P["orders_as_of"]))


def _free_products(spark, sf_dir):
    """The tables with every fifth product given away, so that some orders are cancelled."""
    t = load_star(spark, sf_dir)
    free = F.when(F.col("product_id") % 5 == 0, F.lit(Decimal("0.00"))).otherwise(F.col("unit_price"))
    return t.with_tables(product=t.product.withColumn("unit_price", free.cast("decimal(12,2)")))


def _stored(ledger: DataFrame) -> DataFrame:
    """A ledger is a table that was written with its batch, not a plan that bills again."""
    ensure_checkpoint_dir(ledger.sparkSession)
    return ledger.checkpoint(eager=True)


def _orders_replayed(spark, sf_dir):
    # the whole batch arrives again after it was billed
    requests, when = load_order_requests(spark, sf_dir), _day(P["orders_as_of"])
    first = W.place_orders(_free_products(spark, sf_dir), requests, when)
    return W.place_orders(first.tables, requests, when, applied=_stored(first.ledger))


def _refunds_replayed(spark, sf_dir):
    refunds, when = load_refund_requests(spark, sf_dir), _day(P["refunds_as_of"])
    first = W.record_refunds(load_star(spark, sf_dir), refunds, when)
    return W.record_refunds(first.tables, refunds, when, applied=_stored(first.ledger))


def _refunded(spark, sf_dir):
    return W.record_refunds(load_star(spark, sf_dir), load_refund_requests(spark, sf_dir),
                            _day(P["refunds_as_of"]))


def _in_place(change, pick, name, *args) -> Query:
    """A change made in a table of its own, saved for updates."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pick(change(save_for_updates(load_star(spark, sf_dir), names=(name,)), *args))
    run.__name__ = change.__name__
    return run


_SHIP = (_day(P["ship_as_of"]), P["ship_days"])
_REPRICE = (P["reprice_category"], Decimal(P["reprice_factor"]))
_PURGE = (Decimal(P["purge_limit"]),)

IN_PLACE_QUERIES: dict[str, Query] = {
    "mark_shipped_in_place": _in_place(PW.mark_shipped_in_place, lambda c: c.table, "invoice", *_SHIP),
    "mark_shipped_in_place_affected": _in_place(PW.mark_shipped_in_place, lambda c: c.affected, "invoice", *_SHIP),
    "reprice_category_in_place": _in_place(PW.reprice_category_in_place, lambda c: c.table, "product", *_REPRICE),
    "reprice_category_in_place_affected": _in_place(PW.reprice_category_in_place, lambda c: c.affected, "product", *_REPRICE),
    "purge_small_refunds_in_place": _in_place(PW.purge_small_refunds_in_place, lambda c: c.table, "payment", *_PURGE),
    "purge_small_refunds_in_place_removed": _in_place(PW.purge_small_refunds_in_place, lambda c: c.affected, "payment", *_PURGE),
}


WRITE_QUERIES: dict[str, Query] = {
    "mark_shipped_affected": _write(_shipped, lambda w: w.affected),
    "mark_shipped_state": _write(_shipped, lambda w: w.tables.invoice),
    "add_category_inserted": _write(_categories_added, lambda w: w.affected),
    "add_category_state": _write(_categories_added, lambda w: w.tables.category),
    "map_product_category_state": _write(_brands_mapped, lambda w: w.tables.product_category),
    "map_product_category_rejected": _write(_brands_mapped_again, lambda w: w.rejected),
    "unmap_product_category_state": _write(_inactive_unmapped, lambda w: w.tables.product_category),
    "place_orders_state": _write(_placed, lambda w: w.tables.invoice),
    "record_refunds_state": _write(_refunded, lambda w: w.tables.payment),
    "add_category_rejected": _write(_categories_added, lambda w: w.rejected),
    "map_product_category_inserted": _write(_brands_mapped, lambda w: w.affected),
    "unmap_product_category_removed": _write(_inactive_unmapped, lambda w: w.affected),
    "reprice_category_affected": _write(_repriced, lambda w: w.affected),
    "reprice_category_state": _write(_repriced, lambda w: w.tables.product),
    "purge_small_refunds_removed": _write(_purged, lambda w: w.affected),
    "purge_small_refunds_state": _write(_purged, lambda w: w.tables.payment),
    "place_orders_invoices": _write(_placed, lambda w: w.invoices),
    "place_orders_lines": _write(_placed, lambda w: w.lines),
    "place_orders_payments": _write(_placed, lambda w: w.payments),
    "place_orders_rejected": _write(_placed, lambda w: w.rejected),
    "place_orders_ledger": _write(_placed, lambda w: w.ledger),
    "place_orders_replayed_invoices": _write(_orders_replayed, lambda w: w.invoices),
    "place_orders_replayed_rejected": _write(_orders_replayed, lambda w: w.rejected),
    "record_refunds_ledger": _write(_refunded, lambda w: w.ledger),
    "record_refunds_replayed_payments": _write(_refunds_replayed, lambda w: w.payments),
    "record_refunds_replayed_rejected": _write(_refunds_replayed, lambda w: w.rejected),
    "record_refunds_payments": _write(_refunded, lambda w: w.affected),
    "record_refunds_rejected": _write(_refunded, lambda w: w.rejected),
}


def _pending_invoices_deleted(spark, sf_dir):
    t = load_star(spark, sf_dir)
    ids = t.invoices().filter(F.col("status") == P["delete_status"]).select("invoice_id")
    return Q.cascade_delete(t, "invoice", ids)


def _segment_customers_deleted(spark, sf_dir):
    ids = (raw_table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == P["delete_segment"])
           .select(F.col("c_custkey").alias("customer_id")))
    return Q.cascade_delete(load_star(spark, sf_dir), "customer", ids)


def _invoice_defaults(spark, sf_dir):
    bare = load_order_requests(spark, sf_dir).select(
        F.col("request_id").alias("invoice_id"), "customer_id")
    return Q.apply_defaults(bare, "invoice", _day(P["defaults_as_of"]))


def _payments_from_totals(spark, sf_dir):
    t = load_star(spark, sf_dir)
    return payments_from_totals(t, t.invoices(), P["seed_method"], _day(P["seed_paid_at"]))


def _customers_emptied(spark, sf_dir):
    t = load_star(spark, sf_dir)
    return Q.cascade_delete(t, "invoice", t.invoices().filter(F.col("customer_id") % 10 == 0).select("invoice_id")).tables


def _early_invoices_deleted(spark, sf_dir):
    t = load_star(spark, sf_dir)
    return Q.cascade_delete(t, "invoice", t.invoices().filter(F.col("invoice_date") < _day(P["products_since"])).select("invoice_id")).tables


def _spoilt(spark, sf_dir):
    """The tables with violations of C3 to C6 put in by rule, as a faulty load would leave them."""
    t = load_star(spark, sf_dir)
    money = lambda c, bad, value: F.when(bad, value).otherwise(F.col(c)).cast("decimal(20,2)")
    product = t.product.filter(F.col("product_id") % 50 != 0).select(
        "product_id", F.when(F.col("product_id") % 41 == 0, F.repeat("sku", 6)).otherwise(F.col("sku")).alias("sku"),
        F.when(F.col("product_id") % 43 != 0, F.col("name")).alias("name"), "description",
        money("unit_price", F.col("product_id") % 37 == 0, F.lit(Decimal("-1.00"))).alias("unit_price"), "is_active", "created_at")
    line = t.invoice_line.select(
        "invoice_line_id", "invoice_id", "product_id",
        F.when(F.col("invoice_line_id") % 997 == 0, 0).otherwise(F.col("quantity")).alias("quantity"), "unit_price",
        money("line_total", F.col("invoice_line_id") % 991 == 0, F.lit(Decimal("10000000000.00"))).alias("line_total"))
    payment = t.payment.withColumn("amount", F.when(F.col("payment_id") % 983 != 0, F.col("amount")))
    invoice = t.invoice.filter(F.col("invoice_id") % 100 != 0).withColumn(
        "currency", F.when(F.col("invoice_id") % 89 == 0, "STERLING").otherwise(F.col("currency")))
    return t.with_tables(product=product, invoice_line=line, payment=payment, invoice=invoice)


def _on(make, fn, *args) -> Query:
    """A report or check on a derived state of the tables."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(make(spark, sf_dir), *args)
    run.__name__ = fn.__name__
    return run


def _line_totals_derived(spark, sf_dir):
    return Q.derive_line_total(load_star(spark, sf_dir).invoice_line.filter(F.col("unit_price").isNotNull()).drop("line_total"))


def _defaults(table: str, *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.apply_defaults(load_star(spark, sf_dir).table(table).select(*columns), table, _day(P["defaults_as_of"]))
    return run


def _payments_refused(spark, sf_dir):
    t = load_star(spark, sf_dir)
    return payments_from_totals_rejected(t, t.invoices())


QUALITY_QUERIES: dict[str, Query] = {
    "customers_without_orders_after_delete": _on(_customers_emptied, R.customers_without_orders),
    "products_never_ordered_after_delete": _on(_early_invoices_deleted, R.products_never_ordered),
    "spoilt_foreign_keys": _on(_spoilt, Q.check_foreign_keys),
    "spoilt_not_null": _on(_spoilt, Q.check_not_null),
    "spoilt_domains": _on(_spoilt, Q.check_domains),
    "spoilt_lengths": _on(_spoilt, Q.check_lengths),
    "derive_line_total": _line_totals_derived,
    "apply_defaults_customer": _defaults("customer", "customer_id", "full_name"),
    "apply_defaults_product": _defaults("product", "product_id", "sku", "name", "unit_price"),
    "apply_defaults_payment": _defaults("payment", "payment_id", "invoice_id", "method", "amount"),
    "payment_from_invoice_totals_rejected": _payments_refused,
    "cascade_delete_state": _write(_pending_invoices_deleted, lambda w: w.tables.invoice_line),
    "payment_from_invoice_totals": _payments_from_totals,
    "check_primary_keys": _report(Q.check_primary_keys),
    "check_unique": _report(Q.check_unique),
    "check_foreign_keys": _report(Q.check_foreign_keys),
    "check_not_null": _report(Q.check_not_null),
    "check_domains": _report(Q.check_domains),
    "check_lengths": _report(Q.check_lengths),
    "line_total_audit": _report(Q.audit_line_totals),
    "cascade_delete_removed": _write(_pending_invoices_deleted, lambda w: w.affected),
    "cascade_delete_refused": _write(_segment_customers_deleted, lambda w: w.rejected),
    "apply_defaults_invoice": _invoice_defaults,
}


def all_queries() -> dict[str, Query]:
    return {**REPORT_QUERIES, **LAYOUT_QUERIES, **IN_PLACE_QUERIES, **WRITE_QUERIES, **QUALITY_QUERIES}
