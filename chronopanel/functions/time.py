"""Time as integer microseconds since the epoch, so arithmetic and comparisons are exact in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: str | Column) -> Column:
    """A timestamp without time zone as microseconds (the session's time zone must be UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def floor_div(x: Column, unit: int) -> Column:
    """Floor division that rounds towards minus infinity."""
    return F.floor(x / F.lit(unit)).cast("bigint")


def hours(x: Column) -> Column:
    return x / F.lit(float(HOUR))


def days(x: Column) -> Column:
    return x / F.lit(float(DAY))


def in_window(t: Column, start: Column, end: Column) -> Column:
    """Whether an event falls into (start, end]; false, never null, for a missing event."""
    return F.coalesce((t > start) & (t <= end), F.lit(False))


def period_number(elapsed: Column, period: int = DAY) -> Column:
    """1 for the first period, by elapsed time; never under 1."""
    return F.greatest(F.lit(1).cast("bigint"), floor_div(elapsed, period) + 1)
