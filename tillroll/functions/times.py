"""Zone-free timestamp helpers.

All timestamps of the model are ``timestamp_ntz`` (wall-clock, no zone).  A
Python ``datetime`` passed through ``F.lit`` becomes a zoned timestamp first,
and ``date_trunc`` works in the session zone, so both could move a midnight
value across a boundary when the session zone is not UTC.  These helpers
never consult a zone.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNC_UNITS = ("year", "quarter", "month", "week")


def ntz(value: datetime | date | str) -> Column:
    """A ``timestamp_ntz`` literal with exactly the given wall-clock value."""
    if isinstance(value, datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, date):
        text = value.isoformat() + " 00:00:00"
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def truncate(col: Column, unit: str) -> Column:
    """Start of the year / quarter / month / week / day of a ``timestamp_ntz``,
    as ``timestamp_ntz`` (via the zone-free calendar date)."""
    day = F.to_date(col)
    if unit == "day":
        return day.cast("timestamp_ntz")
    if unit not in TRUNC_UNITS:
        raise ValueError(f"unit must be one of {TRUNC_UNITS + ('day',)}, not {unit!r}")
    return F.trunc(day, unit).cast("timestamp_ntz")
