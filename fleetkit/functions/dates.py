"""Date rules (pure Column functions, codegen-friendly).

All rules take an explicit ``as_of`` instead of reading a wall clock.  Day
counts are *floors* of exact differences, so at noon "due today" is -1 days
until due but 0 days overdue.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0


def ts_lit(value: _dt.datetime | _dt.date | str) -> Column:
    """A TIMESTAMP_NTZ literal that does not depend on the session time zone."""
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def date_lit(value: _dt.date | _dt.datetime | str) -> Column:
    if isinstance(value, _dt.datetime):
        value = value.date()
    return F.lit(str(value)).cast("date")


def as_ntz(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    """Exact microseconds from ``start`` to ``end`` (works on NTZ values)."""
    return F.timestamp_diff("MICROSECOND", as_ntz(start), as_ntz(end))


def days_since(d: Column | str, as_of) -> Column:
    """floor((as_of - d) / 1 day); null when ``d`` is null."""
    d = F.col(d) if isinstance(d, str) else d
    return F.floor(micros_between(d, ts_lit(as_of)) / F.lit(MICROS_PER_DAY)).cast("int")


def days_until(d: Column | str, as_of) -> Column:
    """floor((d - as_of) / 1 day)."""
    d = F.col(d) if isinstance(d, str) else d
    return F.floor(micros_between(ts_lit(as_of), d) / F.lit(MICROS_PER_DAY)).cast("int")


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed hours (seconds / 3600) between two timestamps."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def tolerant_timestamp(text: Column | str) -> Column:
    """ISO timestamp with either ' ' or 'T' separator; anything else -> null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(F.trim(text)).cast("timestamp_ntz")


def tolerant_date(text: Column | str) -> Column:
    """The date part of a tolerant parse (a bare date also parses)."""
    return F.to_date(tolerant_timestamp(text))


def as_of_date(as_of) -> Column:
    return date_lit(as_of)
