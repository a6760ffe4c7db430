"""Integrity rules of the relational schema, re-aimed as data-quality jobs.

Parquet tables enforce no primary, unique, foreign-key, NOT NULL or CHECK
constraint, so each rule is a job that returns its violations.  All checks
return the same columns so they can be unioned into one report:

    rule         which rule (see RULES)
    table_name   table checked
    column_name  column(s) checked (comma-separated for a composite key)
    value        offending key / value as text (NULL for NULL counts)
    n            number of rows behind that violation

Key-level rules (duplicates, orphans) emit one row per offending key;
NULL rules emit one row per (table, column) with the NULL count; row-level
rules (CHECK, width) emit one row per offending row, keyed by its primary key.
Every rule runs as aggregates with map-side combine: no rule moves a whole
table through one task.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.keysets import repeated_keys
from tillroll.functions.money import MONEY_TYPE
from tillroll.functions.times import ntz
from tillroll.operators.writes import Written
from tillroll.sources.schema import PRIMARY_KEYS, SCHEMAS, TABLE_NAMES, RetailTables

FACT_TABLES = ("product_category", "invoice", "invoice_line", "payment")
VIOLATION_COLUMNS = ["rule", "table_name", "column_name", "value", "n"]

# Fixed values of the schema (constraint metadata).
UNIQUE_COLUMNS = [("country", "name"), ("customer", "email"), ("category", "name"),
                  ("product", "sku")]
FOREIGN_KEYS = [  # child table, column, parent table, parent key
    ("customer", "country_id", "country", "country_id"),
    ("product_category", "product_id", "product", "product_id"),
    ("product_category", "category_id", "category", "category_id"),
    ("invoice", "customer_id", "customer", "customer_id"),
    ("invoice_line", "invoice_id", "invoice", "invoice_id"),
    ("invoice_line", "product_id", "product", "product_id"),
    ("payment", "invoice_id", "invoice", "invoice_id"),
]
DOMAIN_CHECKS = [  # table, column, rule text, condition that must hold (NULL passes)
    ("product", "unit_price", "unit_price >= 0", lambda c: c >= 0),
    ("invoice_line", "quantity", "quantity > 0", lambda c: c > 0),
    ("invoice_line", "unit_price", "unit_price >= 0", lambda c: c >= 0),
]
MAX_LENGTHS = [
    ("country", "name", 100), ("customer", "full_name", 150), ("customer", "email", 200),
    ("customer", "phone", 50), ("category", "name", 100), ("product", "sku", 50),
    ("product", "name", 200), ("invoice", "status", 20), ("invoice", "currency", 3),
    ("invoice", "ship_to_country", 100), ("payment", "method", 30), ("payment", "external_ref", 100),
]
MONEY_COLUMNS = [("product", "unit_price"), ("invoice_line", "unit_price"), ("invoice_line", "line_total"), ("payment", "amount")]
# ON DELETE behaviour: child table, column, parent table, cascades?
DELETE_RULES = [
    ("product_category", "product_id", "product", True),
    ("product_category", "category_id", "category", True),
    ("invoice_line", "invoice_id", "invoice", True),
    ("payment", "invoice_id", "invoice", True),
    ("invoice", "customer_id", "customer", False),
    ("invoice_line", "product_id", "product", False),
    ("customer", "country_id", "country", False),
]
DEFAULTS = {  # column defaults applied when the column is omitted ("now" = as_of)
    ("customer", "created_at"): "now",
    ("product", "is_active"): True,
    ("product", "created_at"): "now",
    ("invoice", "invoice_date"): "now",
    ("invoice", "status"): "PENDING",
    ("invoice", "currency"): "GBP",
    ("payment", "paid_at"): "now",
}


def _key_text(cols: list[str]) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])


def _violations(df: DataFrame, rule: str, table: str, column: str) -> DataFrame:
    """df has columns (value, n) -> the common violation shape."""
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                     F.lit(column).alias("column_name"),
                     F.col("value").cast("string").alias("value"),
                     F.col("n").cast("bigint").alias("n"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _tbl(t: RetailTables, name: str, cols: list[str]) -> DataFrame:
    """Only the needed columns; the invoice's derived ship-to is joined only if asked for."""
    if name == "invoice" and "ship_to_country" not in cols:
        return t.invoices().select(*cols)
    return t.table(name).select(*cols)


# ---------------------------------------------------------------------------
# C1 primary keys, C2 unique columns

def check_primary_keys(t: RetailTables) -> DataFrame:
    """Duplicate primary keys (one row per key) and the number of rows with a NULL key part.

    In the large tables bitmaps of key buckets clear the unique keys; only the other buckets are grouped by key."""
    parts = []
    for table in TABLE_NAMES:
        keys = list(PRIMARY_KEYS[table])
        counted = repeated_keys(_tbl(t, table, keys), keys, pack=table in FACT_TABLES)
        parts.append(counted.select(
            F.when(F.col("_null"), F.lit("null_key")).otherwise(F.lit("duplicate_key")).alias("rule"),
            F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("column_name"),
            F.when(~F.col("_null"), _key_text(keys)).alias("value"), F.col("n").cast("bigint").alias("n")))
    return _union(parts)


def check_unique(t: RetailTables) -> DataFrame:
    """Values of UNIQUE columns held by more than one row (NULLs never collide)."""
    parts = []
    for table, col in UNIQUE_COLUMNS:
        dup = (_tbl(t, table, [col]).filter(F.col(col).isNotNull()).groupBy(col)
               .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
               .select(F.col(col).alias("value"), "n"))
        parts.append(_violations(dup, "unique", table, col))
    return _union(parts)


# ---------------------------------------------------------------------------
# C3 foreign keys

def check_foreign_keys(t: RetailTables) -> DataFrame:
    """Non-NULL references without a parent row: one row per orphan value.

    A child is scanned once: GROUPING SETS count the values of all its references in one aggregate with map-side
    combine, and one anti join holds them against the union of their parents' keys.
    """
    parts = []
    for child in dict.fromkeys(fk[0] for fk in FOREIGN_KEYS):
        own = [fk[1:] for fk in FOREIGN_KEYS if fk[0] == child]
        cols = [col for col, _, _ in own]
        rows = _tbl(t, child, cols)
        if len(own) == 1:
            counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("_fk"), F.col(cols[0]).alias("_ref"), "n")
        else:
            counted = rows.groupingSets([[F.col(c)] for c in cols], *cols).agg(
                F.count(F.lit(1)).alias("n"), *(F.grouping(c).alias(f"_g{i}") for i, c in enumerate(cols)))
            which = F.coalesce(*(F.when(F.col(f"_g{i}") == 0, F.lit(i)) for i in range(len(cols))))
            counted = counted.select(which.alias("_fk"), F.coalesce(*cols).alias("_ref"), "n")
        # an anti join ignores duplicate keys on its right side: no distinct
        parents = _union([_tbl(t, parent, [key]).select(F.lit(i).alias("_fk"), F.col(key).alias("_ref")) for i, (_, parent, key) in enumerate(own)])
        orphans = counted.filter(F.col("_ref").isNotNull()).join(parents, ["_fk", "_ref"], "left_anti")
        name = F.element_at(F.array(*(F.lit(f"{col}->{parent}.{key}") for col, parent, key in own)), F.col("_fk") + 1)
        parts.append(orphans.select(F.lit("foreign_key").alias("rule"), F.lit(child).alias("table_name"), name.alias("column_name"),
                                    F.col("_ref").cast("string").alias("value"), F.col("n").cast("bigint").alias("n")))
    return _union(parts)


# ---------------------------------------------------------------------------
# C4 NOT NULL

def check_not_null(t: RetailTables) -> DataFrame:
    """NULL count of every NOT NULL column (one scan per table, all columns at once)."""
    parts = []
    for table in TABLE_NAMES:
        required = [f.name for f in SCHEMAS[table].fields if not f.nullable]
        counts = _tbl(t, table, required).agg(
            *[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in required])
        stacked = counts.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in required
        ])).alias("s")).select("s.*").filter(F.col("n") > 0)
        parts.append(stacked.select(F.lit("not_null").alias("rule"), F.lit(table).alias("table_name"),
                                    "column_name", F.lit(None).cast("string").alias("value"),
                                    F.col("n").cast("bigint").alias("n")))
    return _union(parts)


# ---------------------------------------------------------------------------
# C5 CHECK constraints, C6 widths

def _row_rules(t: RetailTables, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """One scan per table: each row gives the rules (table, column, rule, broken) that it breaks."""
    parts = []
    for table in dict.fromkeys(r[0] for r in rules):
        own = [r for r in rules if r[0] == table]
        keys = list(PRIMARY_KEYS[table])
        columns = list(dict.fromkeys([*keys, *(r[1] for r in own)]))
        broken = F.array_compact(F.array(*[
            F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column_name"))) for _, col, rule, bad in own]))
        # almost no row breaks a rule: only those that do build the array
        some = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, _, _, bad in own])
        parts.append(_tbl(t, table, columns).filter(some).select(_key_text(keys).alias("value"), F.explode(broken).alias("b"))
                     .select("b.rule", F.lit(table).alias("table_name"), "b.column_name", "value",
                             F.lit(1).cast("bigint").alias("n")))
    return _union(parts)


def check_domains(t: RetailTables) -> DataFrame:
    """Rows failing a CHECK (a NULL result passes, as in SQL); value = the row's key."""
    return _row_rules(t, [(table, col, "check:" + text, ~cond(F.col(col))) for table, col, text, cond in DOMAIN_CHECKS])


def check_lengths(t: RetailTables) -> DataFrame:
    """Text wider than its VARCHAR(n) / CHAR(n), and amounts outside NUMERIC(12,2); value = the row's key."""
    wide = [(table, col, f"length>{width}", F.length(F.col(col)) > width) for table, col, width in MAX_LENGTHS]
    big = [(table, col, "numeric(12,2)", F.abs(F.col(col)) >= F.lit(10 ** 10)) for table, col in MONEY_COLUMNS]
    return _row_rules(t, wide + big)


# ---------------------------------------------------------------------------
# C7 generated line_total

def derive_line_total(lines: DataFrame) -> DataFrame:
    """line_total = quantity * unit_price as NUMERIC(12,2) (the generated column)."""
    return lines.withColumn(
        "line_total", (F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")).cast(MONEY_TYPE))


def audit_line_totals(t: RetailTables) -> DataFrame:
    """Lines whose stored line_total differs from quantity * unit_price (NULL-safe)."""
    recomputed = (F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")).try_cast(MONEY_TYPE)
    return (t.invoice_line.select("invoice_line_id", "quantity", "unit_price", "line_total",
                                  recomputed.alias("recomputed"))
            .filter(~F.col("line_total").eqNullSafe(F.col("recomputed"))))


# ---------------------------------------------------------------------------
# C8 delete with ON DELETE rules

def cascade_delete(t: RetailTables, table: str, ids: DataFrame) -> Written:
    """Delete rows of ``table`` whose primary key is in ``ids`` (one column named
    like the key), following the schema's ON DELETE rules.

    Rows referenced from a table without ON DELETE CASCADE are refused (PostgreSQL
    refuses the whole statement; the batch refuses those ids and deletes the
    rest).  Accepted deletions remove the cascading child rows; a child table
    that itself has cascading children (invoice -> lines, payments) is followed.
    ``affected`` = (table_name, n) rows removed per table; ``rejected`` = the
    refused ids with the table that still references them.
    """
    (key,) = PRIMARY_KEYS[table]
    wanted = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    blockers = []
    for child, col, parent, cascades in DELETE_RULES:
        if parent == table and not cascades:
            refs = _tbl(t, child, [col]).filter(F.col(col).isNotNull()).select(
                F.col(col).alias(key)).distinct()  # a hot reference is one row before the join
            blockers.append(wanted.join(refs, key, "left_semi")
                            .withColumn("referenced_by", F.lit(f"{child}.{col}")))
    rejected = _union(blockers) if blockers else wanted.limit(0).withColumn(
        "referenced_by", F.lit(None).cast("string"))
    doomed = wanted.join(rejected.select(key), key, "left_anti")

    changed: dict[str, DataFrame] = {}
    removed = []
    # The schema's cascades are one level deep: no cascading child table
    # (bridge, lines, payments) has cascading children of its own.
    targets = [(table, key)] + [(child, col) for child, col, parent, cascades in DELETE_RULES
                                if parent == table and cascades]
    for tbl, col in targets:
        keys = doomed.withColumnRenamed(key, col)
        current = t.table(tbl)
        # the keys are hashed: a count needs no sort of the table
        removed.append(current.join(keys.hint("shuffle_hash"), col, "left_semi").agg(F.count(F.lit(1)).alias("n"))
                       .select(F.lit(tbl).alias("table_name"), "n"))
        changed[tbl] = current.join(keys, col, "left_anti")
    return Written(t.with_tables(**changed), _union(removed), rejected)


# ---------------------------------------------------------------------------
# C9 column defaults

def apply_defaults(df: DataFrame, table: str, as_of: datetime) -> DataFrame:
    """Complete ``df`` to the full column list of ``table``.

    A column that is *missing* gets its DEFAULT (``now`` = ``as_of``) or NULL;
    a column that is present keeps its values, explicit NULLs included — as
    an INSERT that omits a column differs from one that inserts NULL.
    """
    out = []
    for field in SCHEMAS[table].fields:
        if field.name in df.columns:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
            continue
        default = DEFAULTS.get((table, field.name))
        if default == "now":
            value = ntz(as_of)
        elif default is None:
            value = F.lit(None).cast(field.dataType)
        else:
            value = F.lit(default).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)
