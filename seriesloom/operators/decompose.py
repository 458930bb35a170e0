"""Classical additive decomposition into trend, season and residual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from ..session import materialise
from .chunks import CHUNK_ROWS, over_chunks
from .positions import attach_balanced

PERIOD = 168


def seasonal_decompose(
    positioned: DataFrame,
    column: str,
    *,
    period: int = PERIOD,
    series: Sequence[str] = ("series_id",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``trend``, ``seasonal`` and ``resid``; series shorter than two periods are left out.

    The trend is the centred moving average of one period (an even period takes
    half weight at both ends), NULL where the frame is incomplete. The season is
    the mean of the detrended values per place in the period, shifted to sum to
    zero. Values must be complete; forward-fill the grid first.
    """
    half = period // 2
    even = period % 2 == 0

    def trend(w):
        frame = w.rowsBetween(-half, half)
        total = F.sum(column).over(frame)
        if even:
            ends = F.lag(column, half).over(w) + F.lead(column, half).over(w)
            total = total - ends / 2
        full = F.count(column).over(frame) == 2 * half + 1
        return {"trend": F.when(full, total / period)}

    long_enough = positioned.where(F.col("n") >= 2 * period)
    rows = over_chunks(
        long_enough, trend, series=series, before=half, after=half, chunk_rows=chunk_rows
    ).withColumn("__place", F.pmod(F.col("pos"), F.lit(period)))
    rows = materialise(rows)  # read again for the seasonal means
    keys = list(series)
    gap = F.col(column) - F.col("trend")
    places = rows.groupBy(*keys, "__place").agg(F.avg(gap).alias("__mean"))
    # ``period`` rows per series, so a window over the series is small here.
    level = F.avg("__mean").over(Window.partitionBy(*keys))
    season = places.select(*keys, "__place", (F.col("__mean") - level).alias("seasonal"))
    return (
        attach_balanced(rows, season, keys=[*keys, "__place"], bucket=floor_div(F.col("pos"), chunk_rows))
        .withColumn("resid", F.col(column) - F.col("trend") - F.col("seasonal"))
        .drop("__place")
    )
