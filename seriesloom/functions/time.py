"""Arithmetic on zone-less timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def floor_div(a: Column, b: int) -> Column:
    """Integer division rounding towards minus infinity."""
    a = a.cast("long")
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def epoch_seconds(ts) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ, without a zone conversion."""
    ts = as_column(ts)
    days = F.datediff(ts.cast("date"), F.expr("DATE '1970-01-01'")).cast("long")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    return days * DAY + clock.cast("long")


def from_epoch_seconds(seconds: Column) -> Column:
    days = floor_div(seconds, DAY)
    rest = (seconds - days * DAY).cast("decimal(18,6)")
    zero = F.lit(0)
    origin = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return origin + F.make_dt_interval(days.cast("int"), zero, zero, rest)


def slot_of(ts, step_seconds: int = HOUR) -> Column:
    """Number of the grid step that holds ``ts``."""
    return floor_div(epoch_seconds(ts), step_seconds)


def slot_start(slot: Column, step_seconds: int = HOUR) -> Column:
    return from_epoch_seconds(slot.cast("long") * step_seconds)


def truncate(ts, step_seconds: int = HOUR) -> Column:
    """Start of the grid step that holds ``ts``, as TIMESTAMP_NTZ."""
    return slot_start(slot_of(ts, step_seconds), step_seconds)
