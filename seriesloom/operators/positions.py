"""Row positions and per-series totals without putting a whole series in one task.

A series may hold a third of all rows, so ``row_number`` over a series is out.
Instead the rows are cut into buckets (a fixed span of the order key), each
bucket is counted with map-side combine, a running sum over the small bucket
table gives each bucket its offset, and ``row_number`` runs inside buckets only.
The offsets come back by an equi-join on (series, bucket), which stays balanced
however long one series is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import HOUR, floor_div, slot_of
from ..session import materialise

BUCKET_ROWS = 4096
_BUCKET = "__bucket"


def time_bucket(ts, step_seconds: int, bucket_rows: int) -> Column:
    return floor_div(slot_of(ts, step_seconds), bucket_rows)


def rank_in_buckets(
    df: DataFrame,
    *,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence,
    sums: dict[str, Column] | None = None,
    position: str = "pos",
    size: str = "n",
) -> DataFrame:
    """Add the 0-based position inside ``keys`` and the size of the key.

    ``bucket`` must not decrease along ``order``. ``sums`` maps new column names
    to expressions that are summed over the whole key and attached to each row.
    """
    sums = sums or {}
    tagged = df.withColumn(_BUCKET, bucket)
    counted = tagged.groupBy(*keys, _BUCKET).agg(
        F.count(F.lit(1)).alias("__size"), *[F.sum(e).alias(name) for name, e in sums.items()]
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        *keys,
        _BUCKET,
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
        F.sum("__size").over(whole).alias(size),
        *[F.sum(name).over(whole).alias(name) for name in sums],
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    ranked = tagged.withColumn("__rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, _BUCKET])
        .withColumn(position, F.col("__offset") + F.col("__rank") - 1)
        .drop(_BUCKET, "__offset", "__rank")
    )


def rank_sorted(
    df: DataFrame, *, keys: Sequence[str], order: Sequence, position: str = "pos", size: str = "n"
) -> DataFrame:
    """Add the 0-based position inside ``keys`` by any order, and the size of the key.

    Where no bucket follows from the order, one range shuffle sorts the rows by keys and
    order; a hot key covers as many ranges as it needs. A row's position is its number in
    its range plus the sizes of the key's earlier ranges, a table with at most a row per
    range and key. The sorted rows are stored before they are numbered, so a lost task
    cannot renumber them. Rows that are equal in ``order`` are numbered in any way.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = materialise(ranged.withColumn("__row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__row", 33))
    ranges = ranged.groupBy(*keys, "__range").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__size"))
    renamed = {k: f"__key_{k}" for k in keys}
    whole = Window.partitionBy(*renamed.values())
    before = whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumnsRenamed(renamed | {"__range": "__r"}).select(
        *renamed.values(), "__r", (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__size").over(whole).alias(size),
    )
    same = F.col("__range") == F.col("__r")
    for key, other in renamed.items():
        same = same & F.col(key).eqNullSafe(F.col(other))
    placed = ranged.join(offsets, same).withColumn(position, F.col("__row") + F.col("__shift"))
    return placed.drop("__row", "__range", "__r", "__shift", *renamed.values())


def with_positions(
    df: DataFrame,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = HOUR,
    bucket_rows: int = BUCKET_ROWS,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """``pos`` (0-based, by time) and ``n`` (rows of the series) for a panel.

    The panel holds at most one row per series and timestamp, so a bucket of
    ``bucket_rows`` grid steps bounds what a task sorts.
    """
    return rank_in_buckets(
        df,
        keys=list(series),
        bucket=time_bucket(ts, step_seconds, bucket_rows),
        order=[ts],
        sums=sums,
    )


def attach_balanced(
    df: DataFrame, table: DataFrame, *, keys: Sequence[str], bucket: Column, how: str = "inner"
) -> DataFrame:
    """Join a one-row-per-key ``table`` to many rows, balanced under skew.

    Joining on the key alone sends a hot key to one task. Here the table is first
    spread over the (key, bucket) pairs that really occur (a small table), then
    joined on both. When the spread table is small the adaptive planner turns
    this into a broadcast by measured size.
    """
    tagged = df.withColumn(_BUCKET, bucket)
    present = tagged.select(*keys, _BUCKET).distinct()
    spread = present.join(table, list(keys))
    return tagged.join(spread, [*keys, _BUCKET], how).drop(_BUCKET)


def attach_by_series(
    df: DataFrame,
    table: DataFrame,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = HOUR,
    bucket_rows: int = BUCKET_ROWS,
    how: str = "inner",
) -> DataFrame:
    """``attach_balanced`` for panels: the buckets are time spans."""
    bucket = time_bucket(ts, step_seconds, bucket_rows)
    return attach_balanced(df, table, keys=series, bucket=bucket, how=how)
