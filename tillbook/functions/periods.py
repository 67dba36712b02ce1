"""Reporting periods as half-open timestamp ranges.

The reference compares ``DATE(created_at)`` with ``DATE('now', '-n days')``; here the
reference day ``as_of`` is an explicit parameter and the predicate is written as a
half-open range on the raw timestamp, so it is pushed to the parquet scan (and prunes
date partitions of a materialized ``sales`` table).

Fixed values of the reference: today = the day itself; week = from ``as_of - 7`` days;
month = from ``as_of - 30``; year = from ``as_of - 365``; no upper bound for the
open-ended periods (the reference has none either).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

AS_OF = dt.date(2001, 8, 1)
PERIOD_DAYS = {"week": 7, "month": 30, "year": 365}
PERIODS = ("today", "week", "month", "year", "custom", "all")


def _d(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def period_bounds(period: str, as_of=AS_OF, date_from=None, date_to=None
                  ) -> tuple[dt.datetime | None, dt.datetime | None]:
    """(inclusive lower, exclusive upper) timestamps; None = unbounded."""
    as_of = _d(as_of)
    midnight = dt.datetime.combine(as_of, dt.time())
    if period == "today":
        return midnight, midnight + dt.timedelta(days=1)
    if period in PERIOD_DAYS:
        return midnight - dt.timedelta(days=PERIOD_DAYS[period]), None
    if period == "custom":
        if date_from is None or date_to is None:
            return None, None
        lo = dt.datetime.combine(_d(date_from), dt.time())
        hi = dt.datetime.combine(_d(date_to), dt.time()) + dt.timedelta(days=1)
        return lo, hi
    if period == "all":
        return None, None
    raise ValueError(f"unknown period {period!r}; expected one of {PERIODS}")


def ts_lit(x: dt.datetime) -> Column:
    return F.lit(x.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def in_period(col: str | Column, period: str, as_of=AS_OF, date_from=None, date_to=None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    lo, hi = period_bounds(period, as_of, date_from, date_to)
    pred = F.lit(True)
    if lo is not None:
        pred = pred & (c >= ts_lit(lo))
    if hi is not None:
        pred = pred & (c < ts_lit(hi))
    return pred


def day_range(col: str | Column, date_from=None, date_to=None) -> Column:
    """``DATE(col) >= date_from AND DATE(col) <= date_to`` as a half-open timestamp range."""
    c = F.col(col) if isinstance(col, str) else col
    pred = F.lit(True)
    if date_from:
        pred = pred & (c >= ts_lit(dt.datetime.combine(_d(date_from), dt.time())))
    if date_to:
        pred = pred & (c < ts_lit(dt.datetime.combine(_d(date_to), dt.time()) + dt.timedelta(days=1)))
    return pred


def sql_in_period(col: str, period: str, as_of=AS_OF, date_from=None, date_to=None) -> str:
    """The same predicate as SQL text (for the DuckDB oracle)."""
    lo, hi = period_bounds(period, as_of, date_from, date_to)
    parts = ["TRUE"]
    if lo is not None:
        parts.append(f"{col} >= TIMESTAMP '{lo:%Y-%m-%d %H:%M:%S}'")
    if hi is not None:
        parts.append(f"{col} < TIMESTAMP '{hi:%Y-%m-%d %H:%M:%S}'")
    return " AND ".join(parts)
