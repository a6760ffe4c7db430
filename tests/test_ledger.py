"""Batches that arrive twice, in part or with repeated ids, bill and pay once."""

import collections
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillroll.operators import writes as W
from tillroll.sources.requests import load_order_requests, load_refund_requests
from tillroll.sources.starmap import load_star

SF = "/root/testdata/sf0.001"
WHEN = datetime(2002, 1, 1)


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF)


def billed(*placed):
    """What the lines of some applications say, whatever their ids."""
    return collections.Counter(r for p in placed for r in rows(p.lines.join(p.invoices, "invoice_id").select("customer_id", "product_id", "quantity", "line_total")))


def test_the_rest_of_a_batch_is_billed_once(spark, star):
    requests = load_order_requests(spark, SF)
    early = requests.filter(F.col("request_id") % 2 == 0)  # whole orders: their ids name the parity
    whole = W.place_orders(star, requests, WHEN)
    first = W.place_orders(star, early, WHEN, applied=spark.createDataFrame([], "request_id bigint"))
    second = W.place_orders(first.tables, requests, WHEN, applied=first.ledger)
    assert billed(first, second) == billed(whole) and billed(second)
    assert {r[0] for r in rows(first.ledger)} | {r[0] for r in rows(second.ledger)} == {r[0] for r in rows(whole.ledger)}
    new, old = {r[0] for r in rows(second.invoices)}, {r[0] for r in rows(first.tables.invoice.select("invoice_id"))}
    assert new and not new & old
    reasons = dict(rows(second.rejected.select("request_id", "reason")))
    assert {k for k, r in reasons.items() if r == "already applied"} == {r[0] for r in rows(first.ledger)}
    third = W.place_orders(second.tables, requests, WHEN, applied=first.ledger.unionByName(second.ledger))
    assert rows(third.invoices) == rows(third.lines) == rows(third.payments) == []


def test_ids_that_repeat_or_are_missing(spark, star):
    product = rows(star.product.filter("is_active").select("product_id").limit(1))[0][0]
    customer = rows(star.customer.select("customer_id").limit(1))[0][0]
    line = lambda request, order: (request, order, customer, str(product), "2", None)
    batch = spark.createDataFrame([line(1, "a"), line(2, "b"), line(2, "b"), line(None, "c"), line(3, "d")],
                                  "request_id bigint, order_id string, customer_id bigint, product_id string, quantity string, method string")
    ledger = spark.createDataFrame([(3, "x"), (3, "x"), (99, "x"), (None, "x")], "request_id bigint, other string")
    placed = W.place_orders(star, batch, WHEN, applied=ledger)
    assert [r[0] for r in rows(placed.ledger)] == [1]
    assert sorted(rows(placed.rejected, "request_id", "reason"), key=str) == [
        (2, "request repeated in batch"), (2, "request repeated in batch"), (3, "already applied"), (None, "missing request id")]
    assert len(rows(W.place_orders(star, batch, WHEN).lines)) == 5  # without a ledger ids aren't looked at


def test_refunds_are_paid_once(spark, star):
    refunds = load_refund_requests(spark, SF)
    whole = W.record_refunds(star, refunds, WHEN)
    first = W.record_refunds(star, refunds.filter(F.col("request_id") % 3 == 0), WHEN, applied=spark.createDataFrame([], "request_id bigint"))
    second = W.record_refunds(first.tables, refunds, WHEN, applied=first.ledger)
    paid = lambda *some: collections.Counter(r for s in some for r in rows(s.payments, "invoice_id", "amount"))
    assert paid(first, second) == paid(whole) and paid(second)
    ids = [r[0] for r in rows(second.tables.payment.select("payment_id")) if r[0] is not None]
    assert len(rows(first.payments)) + len(rows(second.payments)) == len(rows(whole.payments)) and max(ids) == max(r[0] for r in rows(second.payments))
    third = W.record_refunds(second.tables, refunds, WHEN, applied=first.ledger.unionByName(second.ledger))
    assert rows(third.payments) == []
    reasons = collections.Counter(r[0] for r in rows(third.rejected, "reason"))
    assert reasons["already applied"] == sum(paid(whole).values())
