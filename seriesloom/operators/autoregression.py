"""Seasonal autoregression of every series, horizon and fold, on the whole history.

The seasonal difference of the target is regressed on its own lags and on the seasonal
differences of exogenous columns. A least-squares fit needs its rows only through sums
of products, so these are summed with map-side combine per series and fold segment and
added up over segments for the expanding training sets: no training row is repeated per
fold, and none is left out. What meets in one group is a small matrix and the rows that a
forecast reads, as many as the longest lag, a season and the horizon.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_ROWS, over_chunks
from .folds import per_horizon

# Lags of the seasonal autoregression and its season.
AR_LAGS = (1, 2, 24, 25, 168)
AR_SEASON = 24
FALLBACK_ROWS = 24


def solve(products: np.ndarray, rows: int) -> np.ndarray:
    """Least-squares weights from the upper triangle of the sums of products, target first."""
    size = int((np.sqrt(8 * len(products) + 1) - 1) / 2)
    if rows < size - 1:
        raise ValueError("fewer complete training rows than coefficients")
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = products
    gram = gram + np.triu(gram, 1).T
    scale = np.sqrt(np.diag(gram))[1:]
    scale[scale == 0] = 1.0
    weights, *_ = np.linalg.lstsq(gram[1:, 1:] / np.outer(scale, scale), gram[1:, 0] / scale, rcond=1e-12)
    return weights / scale


def roll_out(
    weights: np.ndarray, y: np.ndarray, x: np.ndarray, steps: int, lags: Sequence[int], season: int
) -> np.ndarray:
    """Forecast ``steps`` steps after ``y``; ``x`` covers the rows of ``y`` and the steps.

    Forecasts feed the later steps.
    """
    known = len(y)
    shift = x[known:] - x[known - season : known + steps - season]
    drift = weights[0] + shift @ weights[1 + len(lags) :]
    own = weights[1 : 1 + len(lags)]
    values, gaps = list(y), list(y[season:] - y[:-season])
    for step in range(steps):
        gap = drift[step] + sum(w * gaps[-k] for w, k in zip(own, lags))
        gaps.append(gap)
        values.append(values[-season] + gap)
    return np.array(values[known:])


def _segments(splits: int, horizons: Sequence[int]):
    """(horizon, segment) pairs of a row; rows that precede all test rows have one, of horizon 0."""
    oldest = F.col("n") - max(horizons) * splits
    each = [
        F.struct(
            F.lit(int(h)).alias("horizon"),
            F.greatest(F.floor((F.col("pos") - F.col("n") + h * splits) / h), F.lit(-1)).cast("int").alias("segment"),
        )
        for h in horizons
    ]
    before = F.struct(F.lit(0).alias("horizon"), F.lit(-1).alias("segment"))
    return F.when(F.col("pos") < oldest, F.array(before)).otherwise(F.array(*each))


def training_sums(
    rows: DataFrame, exogenous: Sequence[str], horizons: Sequence[int], splits: int, lags: Sequence[int],
    season: int, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``series_id, horizon, fold, products, fit_rows, y_sum, y_rows`` over all training rows.

    Only rows with every lag and column known are in ``products`` and ``fit_rows``.
    """
    size = 2 + len(lags) + len(exogenous)
    cells = list(combinations_with_replacement(range(size), 2))

    def terms(w):
        def change(c, k=0):
            now = F.lag(c, k).over(w) if k else F.col(c)
            return now - F.lag(c, k + season).over(w)

        return {
            "__v": F.array(
                change("__y"), F.lit(1.0), *[change("__y", k) for k in lags], *[change(c) for c in exogenous]
            )
        }

    ready = over_chunks(rows, terms, before=season + max(lags), chunk_rows=chunk_rows)
    v = F.col("__v")
    whole = F.forall("__v", lambda e: e.isNotNull() & ~F.isnan(e))
    known = F.when(~F.isnan("__y"), F.col("__y"))
    ready = ready.select(
        "series_id", F.when(whole, v).alias("__v"), known.alias("__known"), F.explode(_segments(splits, horizons)).alias("__at")
    )
    names = [f"__p{i}" for i in range(len(cells))]
    summed = ready.groupBy("series_id", "__at.horizon", "__at.segment").agg(
        *[F.sum(v[i] * v[j]).alias(name) for name, (i, j) in zip(names, cells)],
        F.count("__v").alias("fit_rows"),
        F.sum("__known").alias("y_sum"),
        F.count("__known").alias("y_rows"),
    )
    # From here on there is a row per series, horizon and segment.
    numbers = F.array(*[F.lit(int(h)) for h in horizons])
    folds = (
        summed.where(F.col("segment") < splits - 1)
        .withColumn("horizon", F.explode(F.when(F.col("horizon") == 0, numbers).otherwise(F.array("horizon"))))
        .withColumn("fold", F.explode(F.sequence(F.col("segment") + 1, F.lit(splits - 1))))
    )
    return folds.groupBy("series_id", "horizon", "fold").agg(
        F.array(*[F.coalesce(F.sum(name), F.lit(0.0)) for name in names]).alias("products"),
        *[F.sum(c).alias(c) for c in ("fit_rows", "y_sum", "y_rows")],
    )


def _forecast(
    rows: pd.DataFrame, sums: pd.DataFrame, exogenous: Sequence[str], lags: Sequence[int], season: int
) -> pd.DataFrame:
    """The test rows of one series, horizon and fold; what cannot be fitted gets a mean."""
    rows = rows.sort_values("pos")
    is_test = rows["is_test"].to_numpy(bool)
    y = rows["__y"].to_numpy(float)[~is_test]
    total = sums.iloc[0]
    tail = y[-FALLBACK_ROWS:]
    tail = tail[~np.isnan(tail)]
    path, error = None, None
    try:
        weights = solve(np.asarray(total["products"], dtype=float), int(total["fit_rows"]))
        path = roll_out(weights, y, rows[list(exogenous)].to_numpy(float), int(is_test.sum()), lags, season)
        if not np.isfinite(path).all():
            raise ValueError("forecast is not finite")
    except (ValueError, np.linalg.LinAlgError) as problem:
        everything = total["y_sum"] / total["y_rows"] if total["y_rows"] else np.nan
        path, error = np.full(is_test.sum(), tail.mean() if tail.size else everything), str(problem)
    return rows[is_test].assign(yhat=path, error=error)


def seasonal_autoregression(
    positioned: DataFrame,
    target: str,
    horizons: Sequence[int],
    splits: int,
    *,
    exogenous: Sequence[str] = (),
    name: str = "linear_ar",
    ts: str = "ts",
    lags: Sequence[int] = AR_LAGS,
    season: int = AR_SEASON,
    spare: int = 1,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Long predictions of the seasonal autoregression for every horizon and fold.

    Without ``exogenous`` only the target's past is used. A fold with fewer complete
    training rows than coefficients, or a gap among the rows that the forecast reads, gets
    the mean of its last 24 known values (of all, if none of these is known) and says why
    in ``error``.
    """
    columns = {c: f"__x{i}" for i, c in enumerate(exogenous)}
    inner = list(columns.values())
    picked = positioned.select(
        "series_id", ts, "pos", "n", F.col(target).cast("double").alias("__y"),
        *[F.col(c).cast("double").alias(own) for c, own in columns.items()],
    )
    sums = training_sums(picked, inner, horizons, splits, lags, season, chunk_rows)
    reach = season + max(lags)
    position, h = F.col("pos"), F.col("horizon")
    start = F.col("n") - h * (splits - F.col("fold"))
    latest = picked.where(position >= F.col("n") - max(horizons) * splits - reach)
    read = (
        per_horizon(latest, horizons, splits, spare)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        .where((position >= start - reach) & (position < start + h))
        .withColumn("is_test", position >= start)
    )
    kind = positioned.schema["series_id"].dataType.simpleString()
    time = positioned.schema[ts].dataType.simpleString()
    schema = f"series_id {kind}, horizon int, fold int, `{ts}` {time}, `__y` double, yhat double, error string"
    result = ["series_id", "horizon", "fold", ts, "__y", "yhat", "error"]
    keys = ["series_id", "horizon", "fold"]

    def run(rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # series too short for the horizon
            return rows.assign(yhat=0.0, error="")[result]
        return _forecast(rows, sums, inner, lags, season)[result]

    # New names for the keys of one side: both stem from the same table.
    sums = sums.withColumnsRenamed({c: f"__{c}" for c in keys})
    solved = read.groupBy(*keys).cogroup(sums.groupBy(*[f"__{c}" for c in keys])).applyInPandas(run, schema)
    clean = F.when(~F.isnan("yhat"), F.col("yhat"))
    return solved.select(
        *keys, ts, F.lit(name).alias("model"), F.col("__y").alias("y"), clean.alias("yhat"), "error"
    )
