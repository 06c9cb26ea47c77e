"""Month bounds and the fixed local-time shift."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from billcycle.schemas import LOCAL_OFFSET_MINUTES


def to_date(value: str | dt.date) -> dt.date:
    """``YYYY-MM`` (a month, read as its first day), ``YYYY-MM-DD`` or a date."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(value if len(value) > 7 else f"{value}-01")


def month_start(value: str | dt.date) -> dt.date:
    return to_date(value).replace(day=1)


def next_month(value: str | dt.date) -> dt.date:
    first = month_start(value)
    return dt.date(first.year + first.month // 12, first.month % 12 + 1, 1)


def month_bounds(value: str | dt.date) -> tuple[dt.date, dt.date, dt.date]:
    """First day, first day of the following month (exclusive end), last day (inclusive end)."""
    end = next_month(value)
    return month_start(value), end, end - dt.timedelta(days=1)


def local_time(ts: str | Column) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return column + F.expr(f"interval {LOCAL_OFFSET_MINUTES} minutes")
