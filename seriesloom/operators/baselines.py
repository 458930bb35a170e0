"""Forecasts that need no model fit, as long predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .chunks import CHUNK_ROWS, over_chunks
from .folds import N_SPLITS, per_horizon, segment, test_rows

SEASON = 24


def with_naive_lags(
    df: DataFrame,
    target: str,
    *,
    series: Sequence[str] = ("series_id",),
    season: int = SEASON,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``persistence`` (previous row) and ``seasonal_naive`` (row ``season`` back)."""

    def build(w):
        return {
            "persistence": F.lag(target, 1).over(w),
            "seasonal_naive": F.lag(target, season).over(w),
        }

    return over_chunks(df, build, series=series, before=season, chunk_rows=chunk_rows)


def train_means(
    df: DataFrame,
    target: str,
    horizons: Sequence[int],
    splits: int,
    *,
    series: Sequence[str] = ("series_id",),
    last: int = SEASON,
    spare: int = 1,
) -> DataFrame:
    """Mean of the last ``last`` training rows of each fold, else of all its training rows.

    Rows are summed once per horizon and segment with map-side combine; the
    expanding training sets are running sums over the segments, so the panel is
    not repeated per fold.
    """
    keys = [*series, "horizon"]
    placed = per_horizon(df, horizons, splits, spare).withColumn("segment", segment(splits))
    sums = placed.groupBy(*keys, "segment").agg(
        F.sum(target).alias("total"), F.count(target).alias("values")
    )
    earlier = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    overall = sums.select(
        *keys,
        F.col("segment").alias("fold"),
        (F.sum("total").over(earlier) / F.sum("values").over(earlier)).alias("mean_all"),
    ).where(F.col("fold") >= 0)
    # A row is among the last rows before fold i when start_i - last <= pos < start_i.
    offset = F.col("pos") - (F.col("n") - F.col("horizon") * splits)
    first_fold = F.greatest(F.floor(offset / F.col("horizon")) + 1, F.lit(0))
    last_fold = F.least(F.floor((offset + last) / F.col("horizon")), F.lit(splits - 1))
    recent = (
        placed.withColumns({"__first": first_fold.cast("int"), "__last": last_fold.cast("int")})
        .where(F.col("__first") <= F.col("__last"))
        .withColumn("fold", F.explode(F.sequence("__first", "__last")))
        .groupBy(*keys, "fold")
        .agg(F.avg(target).alias("mean_last"))
    )
    joined = overall.join(recent, [*keys, "fold"], "left")
    return joined.select(*keys, "fold", F.coalesce("mean_last", "mean_all").alias("mean24"))


def to_long(df: DataFrame, models: Sequence[str], keys: Sequence[str], y: str = "y") -> DataFrame:
    """One row per model: ``keys``, model, y, yhat."""
    entries = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("yhat")) for m in models]
    )
    return df.select(*keys, F.col(y).alias("y"), F.explode(entries).alias("e")).select(
        *keys, "e.model", "y", "e.yhat"
    )


def baseline_predictions(
    positioned: DataFrame,
    target: str,
    horizons: Sequence[int],
    splits: int = N_SPLITS,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    spare: int = 1,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Long predictions of ``persistence``, ``seasonal_naive`` and ``mean24``.

    The first two read the observed previous rows, so at every horizon they are
    one-step and one-season forecasts; ``mean24`` sees training rows only.
    """
    narrow = positioned.select(*series, ts, target, "pos", "n")
    positioned = materialise(narrow)  # read for the lags and for the means
    lagged = with_naive_lags(positioned, target, series=series, chunk_rows=chunk_rows)
    tested = test_rows(lagged, horizons, splits, spare=spare)
    means = train_means(positioned, target, horizons, splits, series=series, spare=spare)
    keys = [*series, "horizon", "fold"]
    wide = tested.join(means, keys, "left").withColumn("y", F.col(target))
    return to_long(wide, ["persistence", "seasonal_naive", "mean24"], [*keys, ts])
