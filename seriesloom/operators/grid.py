"""Hourly panels: aggregation, regular grid, duplicates, time slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import HOUR, floor_div, slot_of, slot_start, truncate
from .positions import BUCKET_ROWS, attach_by_series


def to_panel(
    df: DataFrame,
    *,
    series: Column | str,
    ts: Column | str,
    columns: dict[str, Column],
    step_seconds: int = HOUR,
) -> DataFrame:
    """Aggregate raw rows to one row per series and grid step."""
    key = F.col(series) if isinstance(series, str) else series
    return df.groupBy(
        key.alias("series_id"), truncate(ts, step_seconds).alias("ts")
    ).agg(*[c.alias(name) for name, c in columns.items()])


def regularise(
    df: DataFrame,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = HOUR,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Put every series on a full grid from its first to its last timestamp.

    Missing steps become rows of NULLs. The grid is generated in two levels
    (blocks, then steps of a block), so no row carries a whole series.
    """
    keys = list(series)
    slot = slot_of(ts, step_seconds)
    bounds = df.groupBy(*keys).agg(F.min(slot).alias("__lo"), F.max(slot).alias("__hi"))
    blocks = bounds.withColumn(
        "__block",
        F.explode(F.sequence(floor_div(F.col("__lo"), bucket_rows), floor_div(F.col("__hi"), bucket_rows))),
    )
    start = F.col("__block") * bucket_rows
    steps = blocks.select(
        *keys,
        F.explode(
            F.sequence(
                F.greatest(F.col("__lo"), start),
                F.least(F.col("__hi"), start + (bucket_rows - 1)),
            )
        ).alias("__slot"),
    )
    grid = steps.select(*keys, slot_start(F.col("__slot"), step_seconds).alias(ts))
    return grid.join(df, [*keys, ts], "left")


def keep_first(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first one by ``order``.

    An aggregate with map-side combine, not a window: however many copies a key
    has, each map task sends one row of it. ``order`` has to be unique in a key.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    first = F.min(F.struct(*ordered)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def duplicate_keys(df: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and how many surplus rows they have."""
    return (
        df.groupBy(*keys)
        .agg((F.count(F.lit(1)) - 1).alias("surplus"))
        .where(F.col("surplus") > 0)
    )


def duplicate_report(df: DataFrame, *, keys: Sequence[str], preview: int = 5) -> DataFrame:
    """One row: surplus rows, duplicated keys and duplicated column names, first keys."""
    doubled = duplicate_keys(df, keys=keys)
    names = len(df.columns) - len(set(df.columns))
    totals = doubled.agg(
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicate_keys"),
    )
    label = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    first = doubled.orderBy(*keys).limit(preview).agg(
        F.concat_ws(", ", F.array_sort(F.collect_list(label))).alias("first_keys")
    )
    return totals.select(
        "duplicate_rows",
        "duplicate_keys",
        first.scalar().alias("first_keys"),
        F.lit(names).cast("long").alias("duplicate_columns"),
    )


def last_hours(
    df: DataFrame,
    hours: int,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = HOUR,
) -> DataFrame:
    """Rows later than the last timestamp of the series minus ``hours``."""
    cut = (F.max(ts) - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("__cut")
    limits = df.groupBy(*series).agg(cut)
    return (
        attach_by_series(df, limits, series=series, ts=ts, step_seconds=step_seconds)
        .where(F.col(ts) > F.col("__cut"))
        .drop("__cut")
    )


def last_rows(df: DataFrame, rows: int) -> DataFrame:
    """Last ``rows`` rows of each series of a positioned panel."""
    return df.where(F.col("pos") >= F.col("n") - rows)


def head_and_tail(df: DataFrame, rows: int = 5) -> DataFrame:
    """First and last rows of each series of a positioned panel, labelled."""
    head, tail = F.col("pos") < rows, F.col("pos") >= F.col("n") - rows
    labels = F.array_compact(F.array(F.when(head, F.lit("head")), F.when(tail, F.lit("tail"))))
    return df.where(head | tail).withColumn("part", F.explode(labels))
