"""Forecast accuracy over long predictions ``(keys…, model, y, yhat)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import attach_by_series

METRICS = ("MAE", "RMSE", "MAPE", "RMSLE", "R2")

# Floors used by the two metric flavours.
MAPE_FLOOR = 1e-9
LOG_SHIFT = 1e-9
MAPE_SKIP_BELOW = 1e-8


def strict_metrics(y: str = "y", yhat: str = "yhat") -> dict[str, Column]:
    """MAE, RMSE, MAPE, RMSLE, R2; NULL as soon as one pair is incomplete.

    MAPE floors the denominator, RMSLE clips both sides at zero. With a constant
    target R2 is 1 for a perfect forecast and 0 otherwise.
    """
    a, p = F.col(y), F.col(yhat)
    e = a - p
    log_gap = F.log1p(F.greatest(p, F.lit(0.0)) + LOG_SHIFT) - F.log1p(
        F.greatest(a, F.lit(0.0)) + LOG_SHIFT
    )
    n = F.count(F.lit(1))
    complete = F.count(e) == n
    sse, sst = F.sum(e * e), F.var_pop(a) * n
    r2 = F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))
    values = {
        "MAE": F.avg(F.abs(e)),
        "RMSE": F.sqrt(F.avg(e * e)),
        "MAPE": F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(MAPE_FLOOR))) * 100,
        "RMSLE": F.sqrt(F.avg(log_gap * log_gap)),
        "R2": F.when(n > 1, r2),
    }
    return {name: F.when(complete, v) for name, v in values.items()}


def null_safe_metrics(y: str = "y", yhat: str = "yhat") -> dict[str, Column]:
    """The same five over the complete pairs only.

    MAPE leaves out targets near zero, RMSLE leaves out negative values, R2 is
    NULL for fewer than two rows or a constant target.
    """
    a = F.when(F.col(yhat).isNotNull(), F.col(y))
    p = F.when(F.col(y).isNotNull(), F.col(yhat))
    e = a - p
    gap = F.when((a >= 0) & (p >= 0), F.log1p(a) - F.log1p(p))
    n, sst = F.count(e), F.var_pop(a) * F.count(e)
    return {
        "MAE": F.avg(F.abs(e)),
        "RMSE": F.sqrt(F.avg(e * e)),
        "MAPE": F.avg(F.when(F.abs(a) >= MAPE_SKIP_BELOW, F.abs(e / a))) * 100,
        "RMSLE": F.sqrt(F.avg(gap * gap)),
        "R2": F.when((n > 1) & (sst > 0), 1 - F.sum(e * e) / sst),
    }


def accuracy(
    predictions: DataFrame, keys: Sequence[str], *, null_safe: bool = False
) -> DataFrame:
    """Metrics per key in one aggregate with map-side combine."""
    values = null_safe_metrics() if null_safe else strict_metrics()
    return predictions.groupBy(*keys).agg(*[c.alias(name) for name, c in values.items()])


def fold_mean(
    per_fold: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str] = METRICS,
    *,
    skip_null: bool = False,
) -> DataFrame:
    """Mean over folds; one NULL fold makes the mean NULL unless ``skip_null``."""
    n = F.count(F.lit(1))
    out = [
        (F.avg(m) if skip_null else F.when(F.count(m) == n, F.avg(m))).alias(m) for m in metrics
    ]
    return per_fold.groupBy(*keys).agg(*out)


def fold_summary(
    per_fold: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("MAE", "RMSE", "MAPE")
) -> DataFrame:
    """Means plus a ``folds`` struct with one array per metric, in fold order."""
    arrays = F.struct(
        *[
            F.transform(F.array_sort(F.collect_list(F.struct("fold", m))), lambda x: x[m]).alias(m)
            for m in metrics
        ]
    )
    return per_fold.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), *[F.avg(m).alias(m) for m in metrics], arrays.alias("folds")
    )


def walk_forward_ranking(predictions: DataFrame, *, series: Sequence[str] = ("series_id",)) -> DataFrame:
    """Fold-averaged metrics per series, model and horizon."""
    keys = [*series, "model", "horizon"]
    return fold_mean(accuracy(predictions, [*keys, "fold"]), keys)


def pooled_ranking(predictions: DataFrame, *, series: Sequence[str] = ("series_id",)) -> DataFrame:
    """Block backtest score: metrics over all complete pairs, ranked by MAE per series.

    ``n_rows`` pairs were scored and ``n_failed`` had no forecast, so a model that was
    spared the hard rows can be told from one that was not. A model without any forecast
    has no metrics and comes last.
    """
    keys = [*series, "model"]
    known = predictions.where(F.col("y").isNotNull())
    counts = known.groupBy(*keys).agg(
        F.count("yhat").alias("n_rows"), F.count_if(F.col("yhat").isNull()).alias("n_failed")
    )
    scores = counts.join(accuracy(known.where(F.col("yhat").isNotNull()), keys), keys, "left")
    order = Window.partitionBy(*series).orderBy(F.col("MAE").asc_nulls_last(), "model")
    return scores.withColumn("rank", F.row_number().over(order))


def ranking_table(scores: DataFrame) -> DataFrame:
    """Sink order of a ranking: horizon, then MAE, then model."""
    return scores.orderBy("horizon", "MAE", "model")


def prediction_health(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing count, minimum, maximum and mean of the forecasts."""
    p = F.col("yhat")
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(p.isNull()).alias("missing"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        F.avg(p).alias("mean"),
    )


def model_coverage(
    predictions: DataFrame, *, series: Sequence[str] = ("series_id",), least: float = 0.5
) -> DataFrame:
    """Models whose share of non-null forecasts reaches ``least``."""
    share = F.avg(F.col("yhat").isNotNull().cast("double"))
    return (
        predictions.groupBy(*series, "model").agg(share.alias("coverage")).where(F.col("coverage") >= least)
    )


def common_timestamps(
    predictions: DataFrame,
    models: int,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """Keep timestamps that all ``models`` forecast; series without any stay whole."""
    keys = list(series)
    hours = predictions.groupBy(*keys, ts).agg((F.count_distinct("model") == models).alias("__full"))
    some = hours.groupBy(*keys).agg(F.bool_or("__full").alias("__some"))
    flagged = attach_by_series(hours, some, series=keys, ts=ts)
    kept = flagged.where(F.col("__full") | ~F.col("__some")).select(*keys, ts)
    return predictions.join(kept, [*keys, ts], "left_semi")


def last_fold(predictions: DataFrame, splits: int) -> DataFrame:
    """Forecasts of the last fold, the ones a forecast file holds."""
    return predictions.where(F.col("fold") == splits - 1)
