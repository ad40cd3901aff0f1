"""Date arithmetic with an explicit ``as_of``; nothing here reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(as_of) -> Column:
    """A timestamp column from a literal such as ``'2024-01-15'`` or from a column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def day(as_of) -> Column:
    """The UTC calendar day of ``as_of``."""
    return F.to_date(moment(as_of))


def days_from(c, n: int) -> Column:
    """Calendar day ``n`` days after (or before) the day of ``c``."""
    return F.date_add(F.to_date(_col(c)), n)


def plus_days(ts, n) -> Column:
    """Timestamp plus ``n`` days; NULL when either is NULL."""
    days = n if isinstance(n, Column) else F.lit(n)
    return _col(ts) + F.make_dt_interval(days)


def epoch_date(seconds) -> Column:
    """UTC day of an epoch value as text; ``unknown`` for missing or zero."""
    s = _col(seconds).cast("double")
    return F.when(s.isNull() | (s == 0), F.lit("unknown")).otherwise(
        F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd"))


def next_yearly(date, as_of) -> Column:
    """First yearly recurrence of ``date`` on or after ``as_of``.

    29 February falls on 28 February in common years. A first date still to come is returned as is.
    """
    d, today = F.to_date(_col(date)), day(as_of)
    years = F.year(today) - F.year(d)
    this_year = F.add_months(d, years * 12)
    return F.when(d >= today, d).when(this_year >= today, this_year).otherwise(
        F.add_months(d, (years + 1) * 12))


def reminder_date(date, days_before) -> Column:
    """Day on which to remind."""
    days = days_before if isinstance(days_before, Column) else F.lit(days_before)
    return F.date_sub(F.to_date(_col(date)), days)
