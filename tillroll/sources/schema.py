"""Explicit schemas of the eight retail tables and the bundle that carries them.

Identifiers are ``LongType`` (surrogate keys outgrow 32 bits long before
100 TB); money is ``DecimalType(12, 2)`` exactly as stored, and timestamps are
zone-less ``TimestampNTZType``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ID = T.LongType()
MONEY = T.DecimalType(12, 2)
TS = T.TimestampNTZType()
STR = T.StringType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


COUNTRY = T.StructType([_f("country_id", ID, False), _f("name", STR, False)])

CUSTOMER = T.StructType([
    _f("customer_id", ID, False), _f("full_name", STR, False), _f("email", STR),
    _f("phone", STR), _f("country_id", ID), _f("created_at", TS),
])

CATEGORY = T.StructType([
    _f("category_id", ID, False), _f("name", STR, False), _f("description", STR),
])

PRODUCT = T.StructType([
    _f("product_id", ID, False), _f("sku", STR, False), _f("name", STR, False),
    _f("description", STR), _f("unit_price", MONEY, False),
    _f("is_active", T.BooleanType(), False), _f("created_at", TS),
])

PRODUCT_CATEGORY = T.StructType([_f("product_id", ID, False), _f("category_id", ID, False)])

INVOICE = T.StructType([
    _f("invoice_id", ID, False), _f("customer_id", ID, False), _f("invoice_date", TS, False),
    _f("status", STR, False), _f("currency", STR, False), _f("ship_to_country", STR),
])

INVOICE_LINE = T.StructType([
    _f("invoice_line_id", ID, False), _f("invoice_id", ID, False), _f("product_id", ID, False),
    _f("quantity", T.IntegerType(), False), _f("unit_price", MONEY, False),
    _f("line_total", MONEY),
])

PAYMENT = T.StructType([
    _f("payment_id", ID, False), _f("invoice_id", ID, False), _f("method", STR, False),
    _f("amount", MONEY, False), _f("paid_at", TS), _f("external_ref", STR),
])

SCHEMAS: dict[str, T.StructType] = {
    "country": COUNTRY,
    "customer": CUSTOMER,
    "category": CATEGORY,
    "product": PRODUCT,
    "product_category": PRODUCT_CATEGORY,
    "invoice": INVOICE,
    "invoice_line": INVOICE_LINE,
    "payment": PAYMENT,
}

# Primary keys (composite for the bridge).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "country": ("country_id",),
    "customer": ("customer_id",),
    "category": ("category_id",),
    "product": ("product_id",),
    "product_category": ("product_id", "category_id"),
    "invoice": ("invoice_id",),
    "invoice_line": ("invoice_line_id",),
    "payment": ("payment_id",),
}

TABLE_NAMES = tuple(SCHEMAS)


@dataclass(frozen=True)
class RetailTables:
    """The eight tables of one consistent snapshot.

    ``invoice_core`` is optional: a source whose ``ship_to_country`` has to be
    derived by a join (the star-schema mapping) passes the invoice columns
    without it here, so that operators that never read the ship-to name do not
    plan that join.  ``range_width`` and ``database`` belong to tables saved by
    ``tillroll.sources.layouts``.
    """

    country: DataFrame
    customer: DataFrame
    category: DataFrame
    product: DataFrame
    product_category: DataFrame
    invoice: DataFrame
    invoice_line: DataFrame
    payment: DataFrame
    invoice_core: DataFrame | None = None
    range_width: int | None = None
    database: str | None = None

    def invoices(self) -> DataFrame:
        """Invoice rows without the denormalised ``ship_to_country``."""
        if self.invoice_core is not None:
            return self.invoice_core
        return self.invoice.drop("ship_to_country")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_tables(self, **changed: DataFrame) -> "RetailTables":
        """A new bundle with some tables replaced (the others are shared)."""
        if "invoice" in changed and "invoice_core" not in changed:
            changed["invoice_core"] = None
        return replace(self, **changed)

    def items(self):
        for f in fields(self):
            if f.name in SCHEMAS:
                yield f.name, getattr(self, f.name)
