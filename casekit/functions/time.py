"""Time features (T1-T19) as Column expressions.

Flags follow pandas semantics: a comparison with a missing value is False, then
cast to 0/1 (N1). Case timestamps are TIMESTAMP_NTZ, so hour/weekday do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(pred: Column) -> Column:
    """Three-valued predicate -> 0/1 with NULL as 0."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def parse_ts(col, fmt: str = "MM/dd/yyyy hh:mm:ss a", strict: bool = False) -> Column:
    """Text -> TIMESTAMP_NTZ; bad text -> NULL, or an error when strict."""
    c = _col(col)
    if strict:
        return F.to_timestamp_ntz(c, F.lit(fmt))
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def hour(ts) -> Column:  # T2
    return F.hour(_col(ts))


def day_of_week(ts) -> Column:  # T3, Monday = 0
    return F.weekday(_col(ts))


def month(ts) -> Column:  # T4
    return F.month(_col(ts))


def quarter(ts) -> Column:  # T5
    return F.quarter(_col(ts))


def is_weekend(dow) -> Column:  # T6
    return flag(_col(dow).isin(5, 6))


def hour_in_range(h, lo: int, hi: int, wrap: bool = True) -> Column:
    """Inclusive hour range. ``lo > hi`` is a range across midnight when
    ``wrap``; ``wrap=False`` keeps pandas' ``between(lo, hi)`` which is then
    always 0 (N11)."""
    c = _col(h)
    if lo <= hi:
        return flag(c.between(lo, hi))
    if wrap:
        return flag((c >= lo) | (c <= hi))
    return flag(c.between(lo, hi))


def hour_is(h, value: int) -> Column:  # T12
    return flag(_col(h) == value)


def hour_in_set(h, values) -> Column:  # T13
    return flag(_col(h).isin(list(values)))


def weekend_early(dow, h, lo: int = 0, hi: int = 6) -> Column:  # T14
    return flag(_col(dow).isin(5, 6) & _col(h).between(lo, hi))


def weekday_evening(dow, h, lo: int = 18, hi: int = 22) -> Column:  # T14
    return flag(_col(dow).isin(0, 1, 2, 3, 4) & _col(h).between(lo, hi))


def resolution_hours(created, closed) -> Column:
    """(closed - created) in hours; NULL if either is NULL; may be < 0."""
    return F.timestamp_diff("MICROSECOND", _col(created), _col(closed)) / F.lit(3.6e9)


def resolution_days(hours) -> Column:  # T17
    return _col(hours) / F.lit(24.0)


def fast_resolution(hours, threshold: float = 24) -> Column:  # T18
    return flag(_col(hours) <= threshold)


def has_value(c) -> Column:  # T19 / G1
    return _col(c).isNotNull().cast("int")
