"""Peak-aware evaluation: thresholds, metrics, and the last-month view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import HOUR
from .grid import last_hours
from .positions import attach_by_series
from .quantiles import exact_quantiles

# Peak quantiles, weight of a peak hour, least pairs, days shown.
PEAK_QUANTILES = (0.95, 0.92, 0.89)
PEAK_WEIGHT = 3.0
MIN_PAIRS = 5
VIEW_HOURS = 24 * 31


def peak_thresholds(
    observed: DataFrame,
    *,
    series: Sequence[str] = ("series_id",),
    y: str = "y",
    quantiles: Sequence[float] = PEAK_QUANTILES,
    fixed: float | None = None,
) -> DataFrame:
    """``q, threshold`` per series: a quantile of the observed values, or one fixed value."""
    if fixed is not None:
        entries = F.array(*[F.lit(float(q)) for q in quantiles])
        per_series = observed.groupBy(*series).agg(F.count(F.lit(1)).alias("n"))
        return per_series.select(
            *series, F.explode(entries).alias("q"), F.lit(float(fixed)).alias("threshold")
        )
    found = exact_quantiles(observed, keys=series, value=y, qs=quantiles)
    return found.select(*series, "q", F.col("quantile").alias("threshold"))


def _peak_columns(weight: float) -> dict[str, Column]:
    y, p, t = F.col("y"), F.col("yhat"), F.col("threshold")
    pair = y.isNotNull() & p.isNotNull()
    peak, calm, called = pair & (y >= t), pair & (y < t), pair & (p >= t)
    error, w = F.abs(y - p), F.when(y >= t, F.lit(weight)).otherwise(F.lit(1.0))
    return {
        "__pairs": F.count_if(pair),
        "n_peaks": F.count_if(peak),
        "n_non": F.count_if(calm),
        "MAE_peaks": F.avg(F.when(peak, error)),
        "MAE_nonpeaks": F.avg(F.when(calm, error)),
        "WMAE": F.sum(F.when(pair, w * error)) / F.sum(F.when(pair, w)),
        "__hit": F.count_if(called & peak),
        "__called": F.count_if(called),
    }


def peak_metrics(
    predictions: DataFrame,
    thresholds: DataFrame,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = HOUR,
    weight: float = PEAK_WEIGHT,
) -> DataFrame:
    """Peak metrics per series, model and quantile from long predictions.

    Models with fewer than five complete pairs get NULL metrics and zero counts.
    """
    limits = thresholds.groupBy(*series).agg(
        F.collect_list(F.struct("q", "threshold")).alias("__limits")
    )
    rows = attach_by_series(predictions, limits, series=series, ts=ts, step_seconds=step_seconds)
    exploded = rows.select(
        *series, "model", "y", "yhat", F.explode("__limits").alias("__l")
    ).select(*series, "model", "y", "yhat", "__l.q", "__l.threshold")
    columns = _peak_columns(weight)
    found = exploded.groupBy(*series, "model", "q", "threshold").agg(
        *[c.alias(name) for name, c in columns.items()]
    )
    enough = F.col("__pairs") >= MIN_PAIRS
    hit, called, peaks = F.col("__hit"), F.col("__called"), F.col("n_peaks")
    precision = F.when(enough & (called > 0), hit / called)
    recall = F.when(enough & (peaks > 0), hit / peaks)
    f1 = F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall))
    return found.select(
        *series,
        "model",
        "q",
        "threshold",
        F.when(enough, peaks).otherwise(F.lit(0)).alias("n_peaks"),
        F.when(enough, F.col("n_non")).otherwise(F.lit(0)).alias("n_non"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("MAE_peaks", "MAE_nonpeaks", "WMAE")],
        precision.alias("precision_peak"),
        recall.alias("recall_peak"),
        f1.alias("f1_peak"),
    )


def best_peak_models(
    metrics: DataFrame, *, series: Sequence[str] = ("series_id",), q: float, top: int = 2
) -> DataFrame:
    """Models with the highest recall, ties by lower WMAE; NULLs last."""
    order = Window.partitionBy(*series).orderBy(
        F.col("recall_peak").desc_nulls_last(), F.col("WMAE").asc_nulls_last(), "model"
    )
    ranked = metrics.where(F.abs(F.col("q") - q) < 1e-12).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= top).select(*series, "model", "place", "threshold")


def month_view(
    predictions: DataFrame,
    best: DataFrame,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    hours: int = VIEW_HOURS,
    step_seconds: int = HOUR,
) -> DataFrame:
    """Last ``hours`` of the chosen models with a peak flag per row."""
    recent = last_hours(predictions, hours, series=series, ts=ts, step_seconds=step_seconds)
    # At most ``top`` rows per series on the right; rows per series are bounded by ``hours``.
    return recent.join(best, [*series, "model"]).select(
        *series, ts, "model", "place", "y", "yhat", (F.col("y") >= F.col("threshold")).alias("is_peak")
    )
