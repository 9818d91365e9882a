"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def within_days(later: Column | str, earlier: Column | str, days: int) -> Column:
    """`later` is at most `days` days after `earlier` (the last day counts). Dates and timestamps."""
    return _col(later) <= _col(earlier) + F.expr(f"INTERVAL '{int(days)}' DAY")


def date_range(value: Column | str, start: str, end: str, closed: bool = False) -> Column:
    """`start` <= value < `end`, or <= `end` when `closed`. The bounds are dates written as yyyy-mm-dd."""
    value = _col(value)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return (value >= first) & ((value <= last) if closed else (value < last))
