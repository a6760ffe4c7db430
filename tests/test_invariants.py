"""Invariants and brute-force comparisons on random small tables (hypothesis)."""

from collections import defaultdict
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillroll.operators import reports as R
from tillroll.operators import writes as W
from tillroll.sources.schema import SCHEMAS, TABLE_NAMES, RetailTables

T = datetime(2025, 1, 31)
NAMES = ["Ann", "Ben", "Cy"]  # few names -> homonyms are common
money = st.integers(min_value=0, max_value=5000).map(lambda c: Decimal(c) / 100)
signed = st.integers(min_value=-3000, max_value=5000).map(lambda c: Decimal(c) / 100)


@st.composite
def shops(draw):
    n_cust = draw(st.integers(1, 6))
    customers = [(i, draw(st.sampled_from(NAMES)), None, None,
                  draw(st.one_of(st.none(), st.integers(1, 2))), T) for i in range(1, n_cust + 1)]
    n_prod = draw(st.integers(1, 5))
    products = [(i, f"S{i}", f"item {i}", None, draw(money), draw(st.booleans()), T)
                for i in range(1, n_prod + 1)]
    bridge = sorted({(draw(st.integers(1, n_prod)), draw(st.integers(1, 3)))
                     for _ in range(draw(st.integers(0, 8)))})
    n_inv = draw(st.integers(0, 8))
    invoices = [(i, draw(st.integers(1, n_cust)), T - timedelta(days=draw(st.integers(0, 60))),
                 draw(st.sampled_from(["PAID", "SHIPPED", "PENDING"])), "GBP", None)
                for i in range(1, n_inv + 1)]
    lines, payments = [], []
    if n_inv:
        for j in range(draw(st.integers(0, 14))):
            q, p = draw(st.integers(1, 5)), draw(money)
            lines.append((j + 1, draw(st.integers(1, n_inv)), draw(st.integers(1, n_prod)), q, p,
                          (p * q).quantize(Decimal("0.01"))))
        for j in range(draw(st.integers(0, 10))):
            payments.append((j + 1, draw(st.integers(1, n_inv)), "CARD", draw(signed), T, None))
    return dict(country=[(1, "North"), (2, "South")], customer=customers,
                category=[(1, "A", None), (2, "B", None), (3, "C", None)], product=products,
                product_category=bridge, invoice=invoices, invoice_line=lines, payment=payments)


def make(spark, data):
    return RetailTables(**{n: spark.createDataFrame(data[n], SCHEMAS[n]) for n in TABLE_NAMES})


def half_up(x: Decimal) -> Decimal:
    return x.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=shops())
def test_reports_against_brute_force(spark, data):
    t = make(spark, data)
    cust = {c[0]: c for c in data["customer"]}
    inv = {i[0]: i for i in data["invoice"]}
    lines, pays = data["invoice_line"], data["payment"]

    # R4 = sum of payments = sum of R24.paid over all invoices
    total_paid = sum((p[3] for p in pays), Decimal("0"))
    assert rows(R.net_profit(t)) == [(total_paid,)]
    ids = t.invoice.select("invoice_id")
    assert sum((r[2] for r in rows(R.invoice_balance(t, ids))), Decimal("0")) == total_paid

    # Line revenue of customers with a country
    by_country = defaultdict(Decimal)
    for ln in lines:
        country = cust[inv[ln[1]][1]][4]
        if country is not None:
            by_country[{1: "North", 2: "South"}[country]] += ln[5]
    assert dict(rows(R.revenue_by_country(t))) == dict(by_country)

    # One count per (product, category) bridge row
    by_cat = defaultdict(Decimal)
    for p, c in data["product_category"]:
        for ln in lines:
            if ln[2] == p:
                by_cat["ABC"[c - 1]] += ln[5]
    assert dict(rows(R.revenue_by_category(t))) == dict(by_cat)

    # Per name, average of invoice totals, half-up
    totals = defaultdict(Decimal)
    for ln in lines:
        totals[ln[1]] += ln[5]
    per_name = defaultdict(list)
    for i, tot in totals.items():
        per_name[cust[inv[i][1]][1]].append(tot)
    want = {n: half_up(sum(v) / len(v)) for n, v in per_name.items()}
    assert dict(rows(R.avg_order_value(t))) == want

    # R10 and R7 together cover every name
    names = {c[1] for c in data["customer"]}
    assert {r[0] for r in rows(R.customers_without_orders(t))} | \
        {r[0] for r in rows(R.orders_per_customer(t))} == names

    # R13 / R13b against sums over the explicit line x payment pairs
    intended, literal = set(), set()
    for i in inv:
        ls = [ln[5] for ln in lines if ln[1] == i]
        ps = [p[3] for p in pays if p[1] == i]
        if ls and ps:
            if sum(ps) < sum(ls):
                intended.add(i)
            if sum(p for p in ps for _ in ls) < sum(x for x in ls for _ in ps):
                literal.add(i)
    assert {r[0] for r in rows(R.partial_refunds(t))} == intended
    assert {r[0] for r in rows(R.partial_refunds(t, literal=True))} == literal

    # R12 keep: rank by customer revenue, ties kept
    rev = defaultdict(Decimal)
    for i, tot in totals.items():
        rev[inv[i][1]] += tot
    ranked = sorted(((cust[c][1], r, 1 + sum(1 for o in rev.values() if o > r))
                     for c, r in rev.items()), key=lambda x: (x[2], x[0], x[1]))
    got = sorted(rows(R.top_customers(t, 2, ties="keep")), key=lambda x: (x[2], x[0], x[1]))
    assert got == [x for x in ranked if x[2] <= 2]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=shops())
def test_write_invariants(spark, data):
    t = make(spark, data)
    purged = W.purge_small_refunds(t, Decimal("10"))
    removed = purged.affected.count()
    assert purged.tables.payment.count() == t.payment.count() - removed
    assert W.purge_small_refunds(purged.tables, Decimal("10")).affected.count() == 0
    shipped = W.mark_shipped(t, T)
    statuses = dict(rows(shipped.tables.invoice, "invoice_id", "status"))
    for i, _ in rows(shipped.affected):
        assert statuses[i] == "SHIPPED"
    assert shipped.tables.invoice.count() == t.invoice.count()
