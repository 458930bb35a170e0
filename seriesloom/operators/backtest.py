"""Walk-forward validation and block backtests of fitted models."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import floor_div
from ..session import materialise
from .chunks import CHUNK_ROWS
from .folds import BLOCK_ROWS, N_BLOCKS, N_SPLITS
from .forecasters import Forecaster
from .positions import attach_balanced

# What unsuitable data raises. Lost executors, full disks and mistakes in code are not isolated.
FIT_ERRORS = (ArithmeticError, ValueError, np.linalg.LinAlgError, IllegalArgumentException)
log = logging.getLogger(__name__)


def _one_fold(
    rows: DataFrame,
    name: str,
    model: Forecaster,
    target: str,
    features: Sequence[str],
    horizon: int,
    splits: int,
    fold: int,
    spare: int,
    isolate: bool,
) -> DataFrame:
    """Fit on the rows before a fold and score its test rows; the result is stored."""
    position = F.col("pos")
    start = F.col("n") - horizon * (splits - fold)
    eligible = rows.where(F.col("n") > horizon * (splits + spare))
    # A series whose training rows cannot be used neither takes part in the fit nor is forecast.
    unfit = F.coalesce(F.col("__unfit_from") < start, F.lit(False))
    train = eligible.where((position < start) & ~unfit).drop("__unfit_from", "__unfit")
    tested = (position >= start) & (position < start + horizon)
    scored = eligible.where((position >= start - model.context) & (position < start + horizon))
    reason = F.when(unfit, F.col("__unfit"))

    def long(df: DataFrame, yhat, error) -> DataFrame:
        return df.select(
            "series_id",
            F.lit(horizon).alias("horizon"),
            F.lit(fold).alias("fold"),
            "ts",
            F.lit(name).alias("model"),
            F.col(target).cast("double").alias("y"),
            yhat.alias("yhat"),
            error.alias("error"),
        )

    try:
        fitted = model.fit(train, target, features)
        forecast = F.when(~F.isnan("yhat") & ~unfit, F.col("yhat"))
        # Stored inside the guard: prediction errors surface only when rows are computed.
        return materialise(long(fitted.predict(scored).where(tested), forecast, reason))
    except FIT_ERRORS as problem:
        if not isolate:
            raise
        log.warning("%s, horizon %s, fold %s failed: %s", name, horizon, fold, problem)
        missing = F.lit(None).cast("double")
        return long(eligible.where(tested), missing, F.coalesce(reason, F.lit(str(problem)[:500])))


def unfit_series(rows: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(series_id, __unfit_from, __unfit): series that would spoil a common fit, and why.

    From ``__unfit_from`` on, the position of the first infinite target or feature, no
    training rows of the series can be used; a series without any complete row has none
    from the start. Missing values are not a fault: models leave such rows out.
    """
    columns = [target, *[f for f in features if f != target]]
    values = [F.col(c).cast("double") for c in columns]
    infinite = [F.abs(v) == float("inf") for v in values]
    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull() & ~F.isnan(v)
    found = rows.groupBy("series_id").agg(
        *[F.min(F.when(i, F.struct("pos", F.lit(c).alias("c")))).alias(f"i{k}") for k, (c, i) in enumerate(zip(columns, infinite))],
        F.bool_or(complete).alias("any"),
    )
    worst = F.least(*[F.col(f"i{k}") for k in range(len(columns))]) if len(columns) > 1 else F.col("i0")
    at = F.when(worst.isNotNull(), worst["pos"]).when(~F.col("any"), F.lit(-1))
    why = F.when(worst.isNotNull(), F.concat(F.lit("infinite value of "), worst["c"])).otherwise(F.lit("no complete row"))
    return found.select("series_id", at.cast("long").alias("__unfit_from"), why.alias("__unfit")).where("__unfit_from IS NOT NULL")


def failures(predictions: DataFrame) -> DataFrame:
    """``series_id, model, horizon, fold, error, rows``: the forecasts that are missing for a reason."""
    keys = ["series_id", "model", "horizon", "fold", "error"]
    return predictions.where(F.col("error").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def _flagged(rows: DataFrame, target: str, features: Sequence[str], isolate: bool) -> DataFrame:
    """The rows with the columns of ``unfit_series``, NULL for series without a fault."""
    if isolate:
        found = materialise(unfit_series(rows, target, features))
        if not found.isEmpty():
            bucket = floor_div(F.col("pos"), CHUNK_ROWS)
            return materialise(attach_balanced(rows, found, keys=["series_id"], bucket=bucket, how="left"))
    return rows.withColumns({"__unfit_from": F.lit(None).cast("long"), "__unfit": F.lit(None).cast("string")})


def _no_forecasts(rows: DataFrame) -> DataFrame:
    kind, time = (rows.schema[c].dataType.simpleString() for c in ("series_id", "ts"))
    columns = f"series_id {kind}, horizon int, fold int, ts {time}, model string, y double, yhat double, error string"
    return rows.sparkSession.createDataFrame([], columns)


def walk_forward(
    positioned: DataFrame,
    models: dict[str, Forecaster],
    target: str,
    features: Sequence[str],
    horizons: Sequence[int],
    splits: int = N_SPLITS,
    *,
    spare: int = 1,
    isolate: bool = False,
    parallel: int = 4,
) -> DataFrame:
    """Long predictions of every model, horizon and fold.

    Each fit is a distributed job over all series; up to ``parallel`` of them run
    at once. Test features may hold observed lags of the target, so long horizons
    of feature models are one-step forecasts. ``isolate`` turns a failing fit into
    NULL forecasts with the message in ``error``, and keeps the series of
    ``unfit_series`` out of the fits instead of letting them spoil those of all others:
    their own forecasts are NULL, with the reason in ``error``. Horizons that are too
    long for every series have no rows.
    """
    rows = materialise(positioned)  # read once per fit
    rows = _flagged(rows, target, features, isolate)
    longest = rows.agg(F.max("n")).first()[0] or 0
    possible = [h for h in horizons if longest > h * (splits + spare)]
    jobs = [
        (name, model, target, features, h, splits, fold, spare, isolate)
        for name, model in models.items()
        for h in possible
        for fold in range(splits)
    ]
    if not jobs:
        return _no_forecasts(rows)
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(lambda j: _one_fold(rows, *j), jobs))
    return reduce(DataFrame.unionByName, parts)


def block_backtest(
    positioned: DataFrame,
    models: dict[str, Forecaster],
    target: str,
    features: Sequence[str],
    *,
    block: int = BLOCK_ROWS,
    blocks: int = N_BLOCKS,
    parallel: int = 4,
) -> DataFrame:
    """Refit before each of the last ``blocks`` blocks; failures give NULL forecasts."""
    return walk_forward(
        positioned, models, target, features, [block], blocks, spare=0, isolate=True, parallel=parallel
    )
