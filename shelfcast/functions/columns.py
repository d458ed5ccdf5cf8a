"""Column expressions: safe ratios and calendar periods.

All calendar work is on DATE columns, so the session time zone never matters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

FREQS = ("day", "week", "month")


def as_col(value) -> Column:
    """A column from a name, a Python date or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def ratio(num, den) -> Column:
    """num / den as double, null when den is 0 or null."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def _check(freq: str) -> None:
    if freq not in FREQS:
        raise ValueError(f"freq must be one of {FREQS}, not {freq!r}")


def period_of(ds, freq: str) -> Column:
    """First day of the period that holds ``ds`` (weeks start on Monday)."""
    _check(freq)
    day = as_col(ds).cast("date")
    return day if freq == "day" else F.trunc(day, freq)


def shift_period(period, n, freq: str) -> Column:
    """The period ``n`` steps later (earlier when n < 0)."""
    _check(freq)
    n = F.lit(n) if isinstance(n, int) else n
    if freq == "month":
        return F.add_months(as_col(period), n)
    return F.date_add(as_col(period), n * (7 if freq == "week" else 1))


def period_index(period, freq: str) -> Column:
    """Number of the period on an integer time line; differences count periods."""
    _check(freq)
    p = as_col(period)
    if freq == "month":
        return F.year(p) * 12 + F.month(p) - 1
    days = F.datediff(p, F.lit(dt.date(1970, 1, 5)))  # a Monday
    return days if freq == "day" else F.floor(days / 7).cast("int")


def period_range(first, last, freq: str) -> Column:
    """Array of all periods from first to last, both included."""
    _check(freq)
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[freq]
    return F.sequence(as_col(first), as_col(last), F.expr(step))


def first_full_period(min_ds, freq: str) -> Column:
    """First period that starts on or after the first day of data."""
    lo = as_col(min_ds).cast("date")
    start = period_of(lo, freq)
    return F.when(start == lo, start).otherwise(shift_period(start, 1, freq))


def full_period_end(max_ds, freq: str) -> Column:
    """First day after the last period that the data covers to its end."""
    return period_of(F.date_add(as_col(max_ds).cast("date"), 1), freq)
