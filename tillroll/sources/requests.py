"""Batch request DataFrames derived from the driver's ``events`` table.

The reference takes orders and refunds one at a time from a console prompt, as
typed texts; here a batch of requests is a DataFrame of such texts:

* order requests  <- ``purchase`` events: one line per event; orders are
  (user, calendar day, parity of the event id), so that a customer may place two
  a day; some products, quantities, customers and methods are bad by rule
* refund requests <- ``error`` events: invoice = event_id, amount = value in
  cents; some amounts and invoices are bad by rule
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.starmap import ACTIVE_MAX_SIZE, raw_table, sku_of

ORDER_EVENT = "purchase"
REFUND_EVENT = "error"
QUANTITY_MODULUS = 6


def order_requests(events: DataFrame) -> DataFrame:
    """(request_id, order_id, customer_id, product_id, quantity, method)."""
    e, user = F.col("event_id"), F.col("user_id")
    quantity = (F.floor("value") % QUANTITY_MODULUS).cast("string")
    return (events.filter(F.col("event_type") == ORDER_EVENT)
            .select(e.alias("request_id"),
                    F.concat_ws("-", user.cast("string"), F.to_date("ts").cast("string"), (e % 2).cast("string")).alias("order_id"),
                    F.when(user % 23 == 0, -user - 1).when(e % 29 == 0, user + 1).otherwise(user).alias("customer_id"),
                    F.when(e % 17 == 0, "x").otherwise(F.get_json_object("props", "$.k")).alias("product_id"),
                    F.when(e % 11 == 0, "abc").when(e % 13 == 0, F.concat(quantity, F.lit(".5"))).otherwise(quantity).alias("quantity"),
                    F.when(e % 31 == 0, "CASH").when(user % 4 == 0, " paypal ").when(user % 4 == 1, " ").when(user % 4 == 2, "Card")
                    .alias("method")))


def refund_requests(events: DataFrame) -> DataFrame:
    """(request_id, invoice_id, amount) with the amount as a text."""
    e = F.col("event_id")
    return (events.filter(F.col("event_type") == REFUND_EVENT)
            .select(e.alias("request_id"), F.when(e % 5 == 0, -e).otherwise(e).alias("invoice_id"),
                    F.when(e % 7 == 0, "abc").when(e % 11 == 0, "-5.00")
                    .otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("amount")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_table(spark, sf_dir, "events")


def load_order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_requests(_events(spark, sf_dir))


def load_refund_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refund_requests(_events(spark, sf_dir))


# Catalog-management requests derived from ``part``.

def new_category_rows(part: DataFrame) -> DataFrame:
    """(name, description): every brand as a new category, plus every part type
    again (those already exist, so they exercise the unique-name refusal)."""
    brands = part.select(F.col("p_brand").alias("name"), F.lit("brand").alias("description"))
    types = part.select(F.col("p_type").alias("name"), F.lit("type").alias("description"))
    return brands.distinct().unionByName(types.distinct())


def brand_pairs(part: DataFrame) -> DataFrame:
    """(sku, category): map every product to the category named after its brand."""
    return part.select(sku_of(F.col("p_partkey")).alias("sku"), F.col("p_brand").alias("category"))


def inactive_type_pairs(part: DataFrame, active_max_size: int = ACTIVE_MAX_SIZE) -> DataFrame:
    """(sku, category): unmap inactive products from their part-type category."""
    return (part.filter(F.col("p_size") > active_max_size)
            .select(sku_of(F.col("p_partkey")).alias("sku"), F.col("p_type").alias("category")))
