"""The reference's seed data as a tiny fixture (tests and examples only).

Relative dates are ``as_of - n days``; every payment of the seed equals its
invoice's line total, except the later partial refund of invoice 3.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import SparkSession

from tillroll.sources.schema import SCHEMAS, RetailTables

# Fixed values of the seed fixture.
COUNTRIES = ["United Kingdom", "Germany", "France", "Spain", "USA"]
CUSTOMERS = [  # full_name, email, phone, country_id, created days ago
    ("Alice Brown", "alice@example.com", "+44-1000", 1, 120),
    ("Bob Smith", "bob@example.com", "+49-2000", 2, 90),
    ("Chris Lee", "chris@example.com", "+33-3000", 3, 30),
    ("Diana Wu", "diana@example.com", "+34-4000", 4, 10),
    ("Evan Kim", "evan@example.com", "+1-555", 5, 5),
]
CATEGORIES = [
    ("Stationery", "Pens, pencils, notebooks"),
    ("Home", "Home & kitchen accessories"),
    ("Toys", "Kids toys and games"),
    ("Seasonal", "Holiday / seasonal items"),
]
PRODUCTS = [  # sku, name, description, unit_price, created days ago
    ("ST001", "Pencil Set", "HB pencils (pack of 10)", "3.50", 100),
    ("ST002", "Notebook A5", "A5 lined notebook", "4.20", 100),
    ("HM001", "Ceramic Mug", "350ml mug", "6.90", 80),
    ("HM002", "Tea Towel", "Cotton kitchen towel", "2.80", 80),
    ("TY001", "Building Blocks", "24-piece blocks", "9.99", 60),
    ("SE001", "Xmas Ornament", "Glass ornament", "7.50", 40),
]
PRODUCT_CATEGORY = [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4), (3, 4)]
INVOICES = [  # customer_id, days ago, status, currency, ship_to_country
    (1, 25, "PAID", "GBP", "United Kingdom"),
    (2, 20, "PAID", "EUR", "Germany"),
    (3, 15, "PAID", "EUR", "France"),
    (3, 10, "SHIPPED", "EUR", "France"),
    (4, 7, "PAID", "EUR", "Spain"),
    (5, 3, "PAID", "USD", "USA"),
]
INVOICE_LINES = [  # invoice_id, product_id, quantity, unit_price
    (1, 1, 2, "3.50"), (1, 3, 1, "6.90"), (1, 2, 3, "4.20"),
    (2, 3, 2, "6.90"), (2, 4, 1, "2.80"),
    (3, 6, 2, "7.50"), (3, 1, 5, "3.50"),
    (4, 5, 1, "9.99"), (4, 3, 2, "6.90"),
    (5, 2, 4, "4.20"),
    (6, 1, 1, "3.50"), (6, 6, 1, "7.50"),
]
PAYMENTS = [  # invoice_id, method, amount (None = the invoice's line total), days ago, ref
    (1, "CARD", None, 24, "PAY-1"),
    (2, "CARD", None, 19, "PAY-2"),
    (3, "CARD", None, 14, "PAY-3"),
    (4, "CARD", None, 9, "PAY-4"),
    (5, "PAYPAL", None, 6, "PAY-5"),
    (6, "CARD", None, 2, "PAY-6"),
    (3, "CARD", "-5.00", 12, "REF-3-1"),
]


def seed_tables(spark: SparkSession, as_of: datetime) -> RetailTables:
    def ago(days: int) -> datetime:
        return as_of - timedelta(days=days)

    def df(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])

    lines = []
    totals: dict[int, Decimal] = {}
    for i, (inv, prod, qty, price) in enumerate(INVOICE_LINES, start=1):
        total = Decimal(price) * qty
        totals[inv] = totals.get(inv, Decimal("0")) + total
        lines.append((i, inv, prod, qty, Decimal(price), total))
    payments = [(i, inv, method, Decimal(amount) if amount else totals[inv], ago(days), ref)
                for i, (inv, method, amount, days, ref) in enumerate(PAYMENTS, start=1)]
    return RetailTables(
        country=df("country", [(i, n) for i, n in enumerate(COUNTRIES, start=1)]),
        customer=df("customer", [(i, n, e, p, c, ago(d))
                                 for i, (n, e, p, c, d) in enumerate(CUSTOMERS, start=1)]),
        category=df("category", [(i, n, d) for i, (n, d) in enumerate(CATEGORIES, start=1)]),
        product=df("product", [(i, s, n, d, Decimal(p), True, ago(a))
                               for i, (s, n, d, p, a) in enumerate(PRODUCTS, start=1)]),
        product_category=df("product_category", PRODUCT_CATEGORY),
        invoice=df("invoice", [(i, c, ago(d), st, cur, ship)
                               for i, (c, d, st, cur, ship) in enumerate(INVOICES, start=1)]),
        invoice_line=df("invoice_line", lines),
        payment=df("payment", payments),
    )
