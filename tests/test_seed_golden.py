"""Golden results on the seed fixture, derived by hand from the seed rows."""

from datetime import datetime, timedelta
from decimal import Decimal as D

from conftest import T0, rows

from tillroll.operators import reports as R
from tillroll.operators import writes as W


def ids(spark, col, values):
    return spark.createDataFrame([(v,) for v in values], f"{col} bigint")


def test_browse_products(seed):
    assert rows(R.browse_products(seed), "product_id") == [(i,) for i in range(1, 7)]


def test_best_selling(seed):
    assert rows(R.best_selling(seed)) == [
        ("ST001", "Pencil Set", 8, D("28.00")), ("ST002", "Notebook A5", 7, D("29.40")),
        ("HM001", "Ceramic Mug", 5, D("34.50")), ("SE001", "Xmas Ornament", 3, D("22.50")),
        ("TY001", "Building Blocks", 1, D("9.99")), ("HM002", "Tea Towel", 1, D("2.80"))]


def test_revenue_by_country(seed):
    assert rows(R.revenue_by_country(seed)) == [
        ("France", D("56.29")), ("United Kingdom", D("26.50")), ("Spain", D("16.80")),
        ("Germany", D("16.60")), ("USA", D("11.00"))]


def test_net_profit(seed):
    assert rows(R.net_profit(seed)) == [(D("122.19"),)]


def test_customers_short(seed):
    assert rows(R.customers_short(seed))[0] == (1, "Alice Brown")


def test_revenue_by_category(seed):
    assert rows(R.revenue_by_category(seed)) == [
        ("Stationery", D("57.40")), ("Seasonal", D("57.00")), ("Home", D("37.30")),
        ("Toys", D("9.99"))]


def test_orders_per_customer(seed):
    assert rows(R.orders_per_customer(seed))[0] == ("Chris Lee", 2)
    assert sorted(n for _, n in rows(R.orders_per_customer(seed))) == [1, 1, 1, 1, 2]


def test_avg_order_value_half_cent(seed):
    # Chris Lee: (32.50 + 23.79) / 2 = 28.145 exactly -> 28.15
    assert rows(R.avg_order_value(seed)) == [
        ("Chris Lee", D("28.15")), ("Alice Brown", D("26.50")), ("Diana Wu", D("16.80")),
        ("Bob Smith", D("16.60")), ("Evan Kim", D("11.00"))]


def test_monthly_revenue(seed):
    assert rows(R.monthly_revenue(seed)) == [(datetime(2026, 3, 1), D("127.19"))]


def test_gap_reports_empty(seed):
    assert R.customers_without_orders(seed).count() == 0
    assert R.products_never_ordered(seed).count() == 0


def test_top_customers(seed):
    assert rows(R.top_customers(seed)) == [
        ("Chris Lee", D("56.29"), 1), ("Alice Brown", D("26.50"), 2), ("Diana Wu", D("16.80"), 3)]


def test_partial_refunds(seed):
    assert rows(R.partial_refunds(seed)) == [(3, D("32.50"), D("27.50"))]
    assert rows(R.partial_refunds(seed, literal=True)) == [(3, D("65.00"), D("55.00"))]


def test_last_order(seed):
    got = rows(R.last_order(seed))
    assert [n for n, _ in got] == ["Alice Brown", "Bob Smith", "Chris Lee", "Diana Wu", "Evan Kim"]
    assert got[2][1] == T0 - timedelta(days=10)


def test_buyers_of_category(seed):
    assert sorted(rows(R.buyers_of_category(seed, "Seasonal"))) == [
        ("Alice Brown",), ("Bob Smith",), ("Chris Lee",), ("Evan Kim",)]


def test_invoices_above_average(seed):
    assert rows(R.invoices_above_average(seed)) == [(3, D("32.50")), (1, D("26.50")), (4, D("23.79"))]


def test_search_products(seed):
    assert rows(R.search_products(seed, "mug")) == [("HM001", "Ceramic Mug")]
    assert rows(R.search_products(seed, "MUG")) == [("HM001", "Ceramic Mug")]


def test_customers_min_revenue(seed):
    assert rows(R.customers_min_revenue(seed, 20)) == [
        ("Chris Lee", D("56.29")), ("Alice Brown", D("26.50"))]


def test_category_share(seed):
    assert rows(R.category_share(seed), "category", "pct_of_total") == [
        ("Stationery", D("35.50")), ("Seasonal", D("35.25")), ("Home", D("23.07")),
        ("Toys", D("6.18"))]


def test_refund_flags(seed):
    flags = dict(rows(R.invoice_refund_flags(seed), "invoice_id", "has_refund"))
    assert flags == {1: "N", 2: "N", 3: "Y", 4: "N", 5: "N", 6: "N"}


def test_invoice_details(spark, seed):
    want = ids(spark, "invoice_id", [3, 99])
    assert rows(R.invoice_header(seed, want), "invoice_id", "full_name", "ship_to_country") == [
        (3, "Chris Lee", "France")]
    assert sorted(rows(R.invoice_items(seed, want), "product_name", "quantity")) == [
        ("Pencil Set", 5), ("Xmas Ornament", 2)]
    assert rows(R.invoice_payments(seed, want), "amount") == [(D("32.50"),), (D("-5.00"),)]
    assert sorted(rows(R.invoice_balance(seed, want))) == [
        (3, D("32.50"), D("27.50")), (99, D("0.00"), D("0.00"))]


def test_active_price(spark, seed):
    assert rows(R.active_price(seed, ids(spark, "product_id", [3, 42]))) == [(3, D("6.90"))]


def test_mark_shipped_strict_cutoff(seed):
    got = W.mark_shipped(seed, T0)
    assert sorted(rows(got.affected)) == [(1, "SHIPPED"), (2, "SHIPPED"), (3, "SHIPPED")]
    later = W.mark_shipped(seed, T0 + timedelta(days=1))
    assert 5 in [i for i, _ in rows(later.affected)]
    assert dict(rows(got.tables.invoice, "invoice_id", "status"))[5] == "PAID"


def test_script_order(spark, seed):
    """Statements 11-14 applied in order, then the later reads see the new state."""
    t = W.mark_shipped(seed, T0).tables
    added = W.add_categories(t, spark.createDataFrame([("Gifts", "Giftable items")],
                                                      "name string, description string"))
    assert rows(added.affected, "name") == [("Gifts",)]
    t = added.tables
    pair = spark.createDataFrame([("HM001", "Gifts")], "sku string, category string")
    t = W.map_products(t, pair).tables
    unmapped = W.unmap_products(t, spark.createDataFrame([("HM001", "Seasonal")],
                                                         "sku string, category string"))
    assert rows(unmapped.affected) == [(3, 4)]
    t = unmapped.tables
    repriced = W.reprice_category(t, "Stationery")
    assert sorted(rows(repriced.affected)) == [(1, D("3.85")), (2, D("4.62"))]
    t = repriced.tables
    assert sorted(rows(R.buyers_of_category(t, "Seasonal"))) == [("Chris Lee",), ("Evan Kim",)]
    assert rows(R.category_share(t), "category", "pct_of_total") == [
        ("Stationery", D("35.50")), ("Home", D("23.07")), ("Gifts", D("21.34")),
        ("Seasonal", D("13.92")), ("Toys", D("6.18"))]
    assert W.purge_small_refunds(t).affected.count() == 0


def test_monthly_revenue_other_grains(seed):
    # all six seed invoices fall between 2026-03-03 and 2026-03-25
    assert rows(R.monthly_revenue(seed, "year")) == [(datetime(2026, 1, 1), D("127.19"))]
    assert rows(R.monthly_revenue(seed, "quarter")) == [(datetime(2026, 1, 1), D("127.19"))]
    by_day = rows(R.monthly_revenue(seed, "day"))
    assert len(by_day) == 6 and sum(v for _, v in by_day) == D("127.19")
    weeks = rows(R.monthly_revenue(seed, "week"))
    assert all(d.weekday() == 0 for d, _ in weeks)  # weeks start on Monday
    assert sum(v for _, v in weeks) == D("127.19")
