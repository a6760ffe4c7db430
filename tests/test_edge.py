"""Edge cases (fixture F3): each table built by hand for one trap."""

from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from conftest import rows

from pyspark.sql.types import StructField, StructType

from tillroll.operators import quality as Q
from tillroll.operators import reports as R
from tillroll.operators import writes as W
from tillroll.sources.schema import SCHEMAS, TABLE_NAMES, RetailTables

T = datetime(2025, 6, 30)


def make(spark, **tables):
    """RetailTables from row lists in schema order; unspecified tables are empty."""
    return RetailTables(**{n: spark.createDataFrame(tables.get(n, []), SCHEMAS[n])
                           for n in TABLE_NAMES})


@pytest.fixture(scope="module")
def shop(spark):
    """Homonyms, a customer without country, L != P payments, a 3-category product."""
    return make(
        spark,
        country=[(1, "Aland"), (2, "Borduria")],
        customer=[(1, "Sam Same", "s1@x", None, 1, T), (2, "Sam Same", "s2@x", None, 2, T),
                  (3, "Nora Null", "n@x", None, None, T), (4, "Idle Ida", None, None, 1, T)],
        category=[(1, "A", None), (2, "B", None), (3, "C", None)],
        product=[(1, "S1", "Widget 100%", None, D("10.00"), True, T),
                 (2, "S2", "Gadget_x", None, D("20.00"), True, T),
                 (3, "S3", "Free sample", None, D("0.00"), True, T),
                 (4, "S4", "Old thing", None, D("5.00"), False, T)],
        product_category=[(1, 1), (1, 2), (1, 3)],
        invoice=[(10, 1, T - timedelta(days=30), "PAID", "GBP", "Aland"),
                 (11, 2, T - timedelta(days=20), "PAID", "GBP", "Borduria"),
                 (12, 3, T - timedelta(days=10), "PAID", "EUR", None),
                 (13, 1, T - timedelta(days=5), "PENDING", "GBP", "Aland")],
        invoice_line=[(100, 10, 1, 1, D("10.00"), D("10.00")),
                      (101, 10, 1, 1, D("10.00"), D("10.00")),
                      (102, 10, 1, 1, D("10.00"), D("10.00")),
                      (103, 11, 2, 1, D("20.00"), D("20.00")),
                      (104, 12, 2, 2, D("20.00"), D("40.00"))],
        payment=[(1000, 10, "CARD", D("15.00"), T, None),
                 (1001, 11, "CARD", D("10.00"), T, None),
                 (1002, 11, "CARD", D("10.00"), T, None),
                 (1003, 12, "CARD", D("-0.99"), T, None),
                 (1004, 12, "CARD", D("-1.00"), T, None),
                 (1005, 12, "CARD", D("-1.01"), T, None)],
    )


def test_homonyms_merge_by_name_not_by_id(shop):
    assert dict(rows(R.orders_per_customer(shop)))["Sam Same"] == 3
    assert dict(rows(R.customers_min_revenue(shop, 0)))["Sam Same"] == D("50.00")
    top = rows(R.top_customers(shop, n=3), "full_name", "revenue")
    assert top == [("Nora Null", D("40.00")), ("Sam Same", D("30.00")), ("Sam Same", D("20.00"))]
    # invoices 10 (30.00) and 11 (20.00); invoice 13 has no lines and is not averaged
    assert dict(rows(R.avg_order_value(shop)))["Sam Same"] == D("25.00")


def test_null_country_is_dropped_by_country_revenue(shop):
    assert rows(R.revenue_by_country(shop)) == [("Aland", D("30.00")), ("Borduria", D("20.00"))]


def test_fan_out_errs_both_ways(shop):
    # invoice 10: 3 lines, 1 half payment; invoice 11: 1 line, 2 instalments in full
    intended = {r[0] for r in rows(R.partial_refunds(shop))}
    literal = {r[0] for r in rows(R.partial_refunds(shop, literal=True))}
    assert 10 in intended and 10 not in literal
    assert 11 not in intended and 11 in literal
    assert rows(R.partial_refunds(shop, literal=True).filter("invoice_id = 11")) == [
        (11, D("40.00"), D("20.00"))]


def test_n_to_m_counts_each_category(shop):
    assert sorted(rows(R.revenue_by_category(shop))) == [
        ("A", D("30.00")), ("B", D("30.00")), ("C", D("30.00"))]
    assert rows(R.category_share(shop), "pct_of_total") == [(D("33.33"),)] * 3


def test_gaps_and_balances(spark, shop):
    assert rows(R.customers_without_orders(shop)) == [("Idle Ida", None)]
    assert sorted(rows(R.products_never_ordered(shop))) == [("S3", "Free sample"), ("S4", "Old thing")]
    last = rows(R.last_order(shop))
    assert last[-1] == ("Idle Ida", None)  # NULLS LAST
    ids = spark.createDataFrame([(13,), (12,), (77,)], "invoice_id bigint")
    assert sorted(rows(R.invoice_balance(shop, ids))) == [
        (12, D("40.00"), D("-3.00")), (13, D("0.00"), D("0.00")), (77, D("0.00"), D("0.00"))]


def test_keyword_wildcards_are_live(shop):
    assert rows(R.search_products(shop, "100%")) == [("S1", "Widget 100%")]
    assert sorted(rows(R.search_products(shop, "_"))) == [
        ("S1", "Widget 100%"), ("S2", "Gadget_x"), ("S3", "Free sample"), ("S4", "Old thing")]


def test_refund_flag_is_by_sign(shop):
    flags = dict(rows(R.invoice_refund_flags(shop), "invoice_id", "has_refund"))
    assert flags == {10: "N", 11: "N", 12: "Y", 13: "N"}


def test_ties_at_the_cut(spark):
    t = make(spark,
             customer=[(i, f"C{i}", None, None, None, T) for i in range(1, 6)],
             invoice=[(i, i, T, "PAID", "GBP", None) for i in range(1, 6)],
             invoice_line=[(i, i, 1, 1, D(v), D(v))
                           for i, v in zip(range(1, 6), ["100", "90", "80", "80", "80"])])
    assert rows(R.top_customers(t, 3, ties="cut")) == [
        ("C1", D("100.00"), 1), ("C2", D("90.00"), 2), ("C3", D("80.00"), 3)]
    assert len(rows(R.top_customers(t, 3, ties="keep"))) == 5


def test_purge_limit_is_strict(shop):
    got = W.purge_small_refunds(shop)
    assert rows(got.affected) == [(1003, D("-0.99"))]
    assert got.tables.payment.count() == 5


def test_empty_tables(spark):
    t = make(spark)
    assert rows(R.net_profit(t)) == [(D("0.00"),)]
    assert R.revenue_by_country(t).count() == 0
    assert R.invoices_above_average(t).count() == 0
    assert R.category_share(t).count() == 0
    assert Q.check_primary_keys(t).count() == 0


# ---------------------------------------------------------------------------
# W7 order placement

ORDER_COLS = ("request_id bigint, customer_id bigint, order_id string, product_id string, "
              "quantity string, method string")


def test_place_orders_rules(spark, shop):
    req = spark.createDataFrame([
        (1, 1, "1-1", "1", "2", None),       # ok: 20.00
        (2, 1, "1-1", "1", "1", None),       # repeated product -> its own line
        (3, 1, "1-1", "2", "0", None),       # quantity 0
        (4, 1, "1-1", "2", "-3", None),      # negative quantity
        (5, 1, "1-1", "4", "1", None),       # inactive product
        (6, 1, "1-1", "99", "1", None),      # unknown product
        (7, 42, "42-1", "1", "1", None),      # unknown customer
        (8, 2, "2-1", "3", "5", None),       # only a free product -> cancelled
        (9, 3, "3-2", "2", "1", " paypal "), # customer without country, method trimmed/upper-cased
        (10, 4, "4-2", None, "1", None),   # unparsable product id
    ], ORDER_COLS)
    placed = W.place_orders(shop, req, T)
    inv = {r[0]: r for r in rows(placed.invoices)}
    assert sorted(inv) == [14, 15]  # after the current maximum 13
    assert inv[14][1] == 1 and inv[14][5] == "Aland"
    assert inv[15][1] == 3 and inv[15][5] is None
    lines = rows(placed.lines, "invoice_id", "product_id", "quantity", "line_total")
    assert sorted(lines) == [(14, 1, 1, D("10.00")), (14, 1, 2, D("20.00")), (15, 2, 1, D("20.00"))]
    pays = rows(placed.payments, "invoice_id", "method", "amount")
    assert sorted(pays) == [(14, "CARD", D("30.00")), (15, "PAYPAL", D("20.00"))]
    reasons = dict(rows(placed.rejected, "request_id", "reason"))
    assert reasons == {3: "invalid quantity", 4: "invalid quantity",
                       5: "unknown or inactive product", 6: "unknown or inactive product",
                       7: "unknown customer", 8: "order total is zero", 10: "invalid product id"}
    assert placed.tables.invoice.count() == 6
    assert placed.tables.payment.count() == 8


# ---------------------------------------------------------------------------
# W9 refunds

def test_record_refunds(spark, shop):
    req = spark.createDataFrame([
        (1, 10, 5.0),            # ok, paid 15 so far
        (2, 10, 12.0),           # ok but 12 > 15 - 5 = 10 -> over_refund
        (3, 10, float("nan")),   # rejected
        (4, 10, 0.0),            # rejected
        (5, 10, -2.0),           # rejected
        (6, 999, 1.0),           # unknown invoice
        (7, 11, float("inf")),   # rejected
    ], "request_id bigint, invoice_id bigint, amount double")
    got = W.record_refunds(shop, req, T)
    assert rows(got.affected.orderBy("request_id"), "request_id", "amount", "over_refund") == [
        (1, D("-5.00"), False), (2, D("-12.00"), True)]
    assert sorted(rows(got.affected, "payment_id")) == [(1006,), (1007,)]
    assert dict(rows(got.rejected, "request_id", "reason")) == {
        3: "invalid amount", 4: "invalid amount", 5: "invalid amount", 6: "unknown invoice",
        7: "invalid amount"}
    assert dict(rows(got.tables.invoice, "invoice_id", "status"))[10] == "PAID"


# ---------------------------------------------------------------------------
# integrity rules: one violation each

def test_integrity_rules(spark):
    bad = make(
        spark,
        country=[(1, "X"), (1, "X")],
        customer=[(1, "A", "same@x", None, 7, T), (2, "B", "same@x", None, None, T)],
        category=[(1, "C" * 101, None)],
        product=[(1, "S", "P", None, D("-1.00"), True, T)],
        invoice=[(1, 1, T, "PAID", "GBPX", None)],
        invoice_line=[(1, 1, 1, 0, D("2.00"), D("5.00")), (2, 2, 1, 1, D("2.00"), D("2.00"))],
        payment=[(1, 1, "CARD", D("1.00"), T, None)],
    )
    pk = rows(Q.check_primary_keys(bad), "rule", "table_name", "value", "n")
    assert pk == [("duplicate_key", "country", "1", 2)]
    assert rows(Q.check_unique(bad), "table_name", "value", "n") == [
        ("country", "X", 2), ("customer", "same@x", 2)]
    fk = rows(Q.check_foreign_keys(bad), "table_name", "column_name", "value")
    assert sorted(fk) == [("customer", "country_id->country.country_id", "7"),
                          ("invoice_line", "invoice_id->invoice.invoice_id", "2")]
    dom = rows(Q.check_domains(bad), "rule", "table_name", "value")
    assert sorted(dom) == [("check:quantity > 0", "invoice_line", "1"),
                           ("check:unit_price >= 0", "product", "1")]
    widths = rows(Q.check_lengths(bad), "table_name", "column_name")
    assert sorted(widths) == [("category", "name"), ("invoice", "currency")]
    assert rows(Q.audit_line_totals(bad), "invoice_line_id", "recomputed") == [(1, D("0.00"))]


def test_not_null_rule(spark):
    # as read from files: the declared NOT NULL is not enforced (all fields nullable)
    loose = StructType([StructField(f.name, f.dataType, True) for f in SCHEMAS["customer"]])
    t = make(spark).with_tables(
        customer=spark.createDataFrame([(1, None, None, None, None, None)], loose))
    assert rows(Q.check_not_null(t), "table_name", "column_name", "n") == [("customer", "full_name", 1)]


def test_cascade_delete(spark, shop):
    inv = spark.createDataFrame([(10,), (12,)], "invoice_id bigint")
    got = Q.cascade_delete(shop, "invoice", inv)
    assert dict(rows(got.affected)) == {"invoice": 2, "invoice_line": 4, "payment": 4}
    assert got.tables.invoice.count() == 2 and got.tables.payment.count() == 2
    cust = spark.createDataFrame([(1,), (4,)], "customer_id bigint")
    got = Q.cascade_delete(shop, "customer", cust)
    assert rows(got.rejected) == [(1, "invoice.customer_id")]
    assert sorted(rows(got.tables.customer, "customer_id")) == [(1,), (2,), (3,)]
    prod = spark.createDataFrame([(1,), (3,)], "product_id bigint")
    got = Q.cascade_delete(shop, "product", prod)  # 1 is sold -> refused; 3 goes
    assert rows(got.rejected) == [(1, "invoice_line.product_id")]
    assert got.tables.product_category.count() == 3


def test_apply_defaults(spark):
    df = spark.createDataFrame([(1, 5, None)], "invoice_id bigint, customer_id bigint, status string")
    got = rows(Q.apply_defaults(df, "invoice", T))
    assert got == [(1, 5, T, None, "GBP", None)]  # explicit NULL status kept, currency defaulted


def test_batches_where_everything_is_refused(spark, shop):
    req = spark.createDataFrame([(1, 99, "99-1", "1", "1", None)], ORDER_COLS)
    placed = W.place_orders(shop, req, T)
    assert placed.invoices.count() == 0 and placed.lines.count() == 0
    assert placed.payments.count() == 0
    assert rows(placed.rejected, "request_id", "reason") == [(1, "unknown customer")]
    refunds = spark.createDataFrame([(1, 999, 1.0)], "request_id bigint, invoice_id bigint, amount double")
    got = W.record_refunds(shop, refunds, T)
    assert got.affected.count() == 0 and got.tables.payment.count() == 6


def test_place_orders_refuses_bad_texts_and_keeps_the_rest(spark, shop):
    req = spark.createDataFrame([
        (1, 1, "a", "1", "abc", None), (2, 1, "a", "x", "1", None), (3, 1, "a", "1", "2.5", None),
        (4, 1, "a", "1", "2.0", ""), (5, 1, "a", "1", "1", "PayPal "),   # one order, one method, a blank ignored
        (6, 1, "b", "1", "1", "card"), (7, 1, "b", "2", "1", "PAYPAL"),  # two methods
        (8, 1, "c", "1", "1", None), (9, 2, "c", "1", "1", None),        # two customers
        (10, 1, "d", "1", "1", None), (11, 1, "e", "1", "1", None),      # two orders of one customer
        (12, 1, None, "1", "1", None), (13, 1, "f", "1", "99999999999999999999", None),
    ], ORDER_COLS)
    placed = W.place_orders(shop, req, T)
    assert dict(rows(placed.rejected, "request_id", "reason")) == {
        1: "invalid quantity", 2: "invalid product id", 3: "invalid quantity", 6: "payment methods disagree",
        7: "payment methods disagree", 8: "customers disagree", 9: "customers disagree", 12: "missing order id",
        13: "invalid quantity"}
    assert sorted(rows(placed.payments, "method", "amount")) == [
        ("CARD", D("10.00")), ("CARD", D("10.00")), ("PAYPAL", D("30.00"))]


def test_refund_amounts_as_texts_and_decimals(spark, shop):
    req = spark.createDataFrame([(1, 10, "5.00"), (2, 10, "abc"), (3, 10, None), (4, 10, "99999999999")],
                                "request_id bigint, invoice_id bigint, amount string")
    got = W.record_refunds(shop, req, T)
    assert rows(got.affected, "request_id", "amount") == [(1, D("-5.00"))]
    assert sorted(rows(got.rejected, "request_id")) == [(2,), (3,), (4,)]
    exact = spark.createDataFrame([(1, 10, D("0.07"))], "request_id bigint, invoice_id bigint, amount decimal(20,4)")
    assert rows(W.record_refunds(shop, exact, T).affected, "amount") == [(D("-0.07"),)]


def test_blank_category_name_is_a_name(spark, shop):
    got = W.add_categories(shop, spark.createDataFrame([("", "d"), (None, "d")], "name string, description string"))
    assert rows(got.affected, "name") == [("",)] and rows(got.rejected, "reason") == [("missing name",)]


def test_orphan_lines_do_not_count(spark):
    t = make(spark, customer=[(1, "A", None, None, None, T)], invoice=[(2, 1, T, "PAID", "GBP", None), (3, 1, T, "PAID", "GBP", None)],
             invoice_line=[(1, 1, 1, 1, D("99"), D("99")), (2, 2, 1, 1, D("5"), D("5")), (3, 3, 1, 1, D("2"), D("2"))],
             payment=[(1, 1, "CARD", D("1"), T, None), (2, 2, "CARD", D("1"), T, None)])
    assert rows(R.invoices_above_average(t), "invoice_id") == [(2,)]
    assert rows(R.partial_refunds(t), "invoice_id") == [(2,)]
    assert rows(R.partial_refunds(t, literal=True), "invoice_id") == [(2,)]


def test_null_keys_and_numeric_range(spark):
    loose = StructType([StructField(f.name, f.dataType, True) for f in SCHEMAS["country"]])
    t = make(spark).with_tables(
        country=spark.createDataFrame([(None, "A"), (None, "B"), (3, "C")], loose),
        payment=spark.createDataFrame([(1, 1, "CARD", D("10000000000.00"), T, None)],
                                      "payment_id long, invoice_id long, method string, amount decimal(20,2), paid_at timestamp_ntz, external_ref string"))
    assert rows(Q.check_primary_keys(t), "rule", "value", "n") == [("null_key", None, 2)]
    assert rows(Q.check_lengths(t), "rule", "column_name", "value") == [("numeric(12,2)", "amount", "1")]
