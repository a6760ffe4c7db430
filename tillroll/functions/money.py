"""Exact money arithmetic as built-in Column expressions (JVM side, codegen).

Money is ``decimal(12,2)`` as stored.  Sums are widened to ``decimal(38,2)``
so that results have one type whatever engine sums them.  Averages and shares
are computed on integer cents with an explicit half-away-from-zero rounding,
which is what ``ROUND(numeric, 2)`` does on exact numerics; this keeps the
result independent of how an engine carries intermediate digits.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TOTAL_TYPE = "decimal(38,2)"
CENTS_TYPE = "decimal(38,0)"
MONEY_TYPE = "decimal(12,2)"


def money_sum(col: Column | str) -> Column:
    """SUM of a money column, typed decimal(38,2) (NULL over no rows)."""
    return F.sum(col).cast(TOTAL_TYPE)


def to_total(col: Column | str) -> Column:
    return F.col(col).cast(TOTAL_TYPE) if isinstance(col, str) else col.cast(TOTAL_TYPE)


def cents(col: Column | str) -> Column:
    """Exact integer cents of a 2-decimal money value."""
    c = F.col(col) if isinstance(col, str) else col
    return (c.cast(TOTAL_TYPE) * F.lit(100)).cast(CENTS_TYPE)


def from_cents(col: Column, dtype: str = TOTAL_TYPE) -> Column:
    """Integer cents back to a 2-decimal value."""
    return (col.cast(CENTS_TYPE) * F.lit(Decimal("0.01"))).cast(dtype)


def half_up_div(num: Column, den: Column) -> Column:
    """round(num / den) with ties away from zero, for integers and den > 0.

    ``div`` on decimal(38,0) is an exact integer quotient, so no digit is
    lost whatever the magnitudes; the quotient itself must fit a long, which
    holds for averages and percentages of money.
    """
    n = num.cast(CENTS_TYPE)
    d = den.cast(CENTS_TYPE)
    mag = F.call_function("div", F.abs(n) * F.lit(2) + d, d * F.lit(2))
    return F.when(d <= 0, F.lit(None)).when(n < 0, -mag).otherwise(mag)


def avg_money(sum_cents: Column, count: Column) -> Column:
    """ROUND(AVG(x), 2) from the exact cent sum and the row count."""
    return from_cents(half_up_div(sum_cents, count))


def percent_of(part_cents: Column, whole_cents: Column) -> Column:
    """ROUND(100 * part / whole, 2); NULL when ``whole`` is 0 (no division error)."""
    hundredths = half_up_div(part_cents.cast(CENTS_TYPE) * F.lit(10000), whole_cents)
    return F.when(whole_cents == 0, F.lit(None)).otherwise(from_cents(hundredths))
