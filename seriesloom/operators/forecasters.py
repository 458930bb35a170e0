"""Forecasting models behind one protocol.

Tree and window models are one global Spark ML fit over all series; the autoregression
of single series is in ``autoregression``.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import inverse_signed_log1p, numeric_columns, signed_log1p
from ..functions.time import floor_div
from ..session import ensure_checkpoints, materialise
from .boosting import Booster, boost
from .chunks import CHUNK_ROWS
from .folds import holdout, lookback_windows
from .positions import attach_balanced
from .scaling import Moments, moments, standardise, standardised, unstandardise

# Columns the exogenous autoregression leaves out by default.
EXOGENOUS_BLACKLIST = (
    "co2_objetosc", "gaz_objetosc", "season_summer", "hour", "month", "season_spring",
    "season_winter", "kurs_eur_pln", "kurs_usd_pln",
)


def exogenous_columns(df: DataFrame, target: str, blacklist: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order without the target and the blacklist."""
    return numeric_columns(df, exclude={target, *blacklist})


class Fitted(Protocol):
    def predict(self, rows: DataFrame, series: Sequence[str] = ("series_id",)) -> DataFrame:
        """``rows`` with a column ``yhat``; ``series`` are the columns that tell rows of one past apart."""


class Forecaster(Protocol):
    """``fit`` sees positioned training rows only; the fitted model scores any rows."""

    context: int

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> Fitted: ...


@dataclass(frozen=True)
class FittedTrees:
    model: object
    features: tuple[str, ...]
    base: float | None = None  # of models that predict the part above it in ``__above``

    def predict(self, rows: DataFrame, series: Sequence[str] = ("series_id",)) -> DataFrame:
        scored = self.model.transform(_assembled(rows, self.features, "keep")).drop("__x")
        if self.base is None:
            return scored
        return scored.withColumn("yhat", F.lit(self.base) + F.col("__above")).drop("__above")


def _assembled(rows: DataFrame, features: Sequence[str], invalid: str = "skip") -> DataFrame:
    maker = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid=invalid)
    return maker.transform(rows)


def _boosted(target: str, rounds: int, seed: int, **params) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="__x", labelCol=target, predictionCol="yhat", maxIter=rounds, seed=seed, **params
    )


def _series_shares(train: DataFrame) -> DataFrame:
    """Positions inside the training rows: ``n`` becomes the training size of a series."""
    sizes = train.groupBy("series_id").agg((F.max("pos") + 1).alias("n"))
    # A training fold is a prefix, so its size is the largest position plus one.
    bucket = floor_div(F.col("pos"), CHUNK_ROWS)
    return attach_balanced(train.drop("n"), sizes, keys=["series_id"], bucket=bucket)


@dataclass(frozen=True)
class FittedPlane:
    weights: dict[str, float]
    base: float

    def predict(self, rows: DataFrame, series: Sequence[str] = ("series_id",)) -> DataFrame:
        parts = [F.lit(w) * F.col(c).cast("double") for c, w in self.weights.items()]
        return rows.withColumn("yhat", sum(parts, F.lit(self.base)))


@dataclass(frozen=True)
class LeastSquares:
    """Linear regression on the features of the same row, from one row of covariances."""

    context: int = 0

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> FittedPlane:
        names = [*features, target]
        rows = train.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna("any")
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        found = rows.agg(
            *[F.avg(c).alias(c) for c in rows.columns],
            *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        if found["v0"] is None:
            raise ValueError("no training rows")
        spread = np.zeros((len(names), len(names)))
        for i, j in pairs:
            spread[i, j] = spread[j, i] = found[f"c{i}_{j}"]
        weights, *_ = np.linalg.lstsq(spread[:-1, :-1], spread[:-1, -1], rcond=1e-12)
        base = found[f"v{len(names) - 1}"] - sum(w * found[f"v{i}"] for i, w in enumerate(weights))
        return FittedPlane(dict(zip(features, map(float, weights), strict=True)), float(base))


def _tree_of(**params) -> dict:
    """Settings of a boosting round's tree."""
    return {k: v for k, v in params.items() if k != "stepSize"}


@dataclass(frozen=True)
class GradientBoosting:
    """Boosted trees; the number of rounds minimises the error on the last rows.

    A first fit leaves out the last ``validation`` of each series, the mean
    absolute error after every round picks the number of trees, and a second fit
    uses all rows. The first fit trains ``max_rounds``, or until the error has not
    fallen for ``patience`` rounds.
    """

    max_rounds: int = 1500
    validation: float = 0.1
    learning_rate: float = 0.015
    depth: int = 4
    subsample: float = 0.8
    min_leaf: int = 15
    patience: int | None = None
    seed: int = 42
    context: int = 0

    def _booster(self, rows: DataFrame) -> Booster:
        return Booster(
            rows, rate=self.learning_rate, seed=self.seed, maxDepth=self.depth,
            subsamplingRate=self.subsample, minInstancesPerNode=self.min_leaf, featureSubsetStrategy="all",
        )

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> FittedTrees:
        ensure_checkpoints(train.sparkSession)
        rows = holdout(_series_shares(train), self.validation)
        ready = materialise(
            _assembled(rows, features).select(
                "__x", F.col(target).cast("double").alias("__y"), (F.col("role") == "valid").alias("__valid")
            )
        )
        best = boost([self._booster(ready)], self.max_rounds, self.patience)
        last = self._booster(ready.drop("__valid"))
        boost([last], best, None)
        return FittedTrees(last.model(best), tuple(features), last.base)


@dataclass(frozen=True)
class CrossValidatedBoosting:
    """Boosted trees; the number of rounds comes from cross-validation with patience.

    The folds are ordered in time, so a fold never validates on rows older than its
    training rows. They advance together, a round at a time, and stop when their mean
    error has not fallen for ``patience`` rounds.
    """

    max_rounds: int = 5000
    patience: int = 50
    folds: int = 3
    search: dict = field(
        default_factory=lambda: {
            "stepSize": 0.04, "maxDepth": 7, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.6"
        }
    )
    final: dict = field(
        default_factory=lambda: {
            "stepSize": 0.03, "maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"
        }
    )
    seed: int = 42
    context: int = 0

    def _booster(self, rows: DataFrame, params: dict) -> Booster:
        return Booster(rows, rate=params["stepSize"], seed=self.seed, **_tree_of(**params))

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> FittedTrees:
        part = F.floor(F.col("pos") * (self.folds + 1) / F.col("n")).cast("int")
        ensure_checkpoints(train.sparkSession)
        rows = _series_shares(train).withColumn("part", part)
        ready = materialise(_assembled(rows, features).select("__x", F.col(target).cast("double").alias("__y"), "part"))
        # Fold i trains on parts 0..i and validates on the next.
        folds = [
            self._booster(
                ready.where(F.col("part") <= i + 1).withColumn("__valid", F.col("part") == i + 1), self.search
            )
            for i in range(self.folds)
        ]
        rounds = boost(folds, self.max_rounds, self.patience)
        last = self._booster(ready, self.final)
        boost([last], rounds, None)
        return FittedTrees(last.model(rounds), tuple(features), last.base)


# Search grids of the two boosting models.
BOOSTING_GRID = {
    "maxIter": (1300, 1700, 2600),
    "stepSize": (0.01, 0.02, 0.03, 0.04, 0.05),
    "maxDepth": (3, 4, 6, 7, 8),
    "subsamplingRate": (0.7, 0.8, 1.0),
}
CROSS_VALIDATED_GRID = {
    "maxIter": (1500, 2500, 3500),
    "stepSize": (0.03, 0.05, 0.07),
    "maxDepth": (3, 4, 6),
    "subsamplingRate": (0.7, 0.8),
    "featureSubsetStrategy": ("0.6", "0.7", "0.8"),
}


@dataclass(frozen=True)
class RandomSearch:
    """Boosted trees with settings drawn from a grid, scored on time-ordered folds."""

    grid: dict = field(default_factory=lambda: dict(BOOSTING_GRID))
    draws: int = 20
    splits: int = 5
    horizon: int = 168
    min_leaf: int = 1
    seed: int = 42
    parallel: int = 8
    context: int = 0

    def settings(self) -> list[dict]:
        """Distinct draws without replacement from the whole grid."""
        total = int(np.prod([len(v) for v in self.grid.values()]))
        picks = random.Random(self.seed).sample(range(total), min(self.draws, total))
        out = []
        for number in picks:
            chosen = {}
            for name, values in self.grid.items():
                number, at = divmod(number, len(values))
                chosen[name] = values[at]
            out.append(chosen)
        return out

    def _score(self, ready: DataFrame, target: str, params: dict, fold: int) -> float:
        start = F.col("n") - self.horizon * (self.splits - fold)
        train = ready.where(F.col("pos") < start)
        valid = ready.where((F.col("pos") >= start) & (F.col("pos") < start + self.horizon))
        model = self._estimator(target, params).fit(train)
        return model.transform(valid).agg(F.avg(F.abs(F.col(target) - F.col("yhat")))).first()[0]

    def _estimator(self, target: str, params: dict) -> GBTRegressor:
        rest = {k: v for k, v in params.items() if k != "maxIter"}
        return _boosted(target, params["maxIter"], self.seed, minInstancesPerNode=self.min_leaf, **rest)

    def scores(self, train: DataFrame, target: str, features: Sequence[str]) -> list[tuple[dict, float]]:
        """Mean validation error of each drawn setting; fits run side by side."""
        ensure_checkpoints(train.sparkSession)
        rows = _series_shares(train)
        ready = _assembled(rows, features).select("__x", F.col(target).cast("double"), "pos", "n")
        drawn = self.settings()
        jobs = [(p, f) for p in drawn for f in range(self.splits)]
        with ThreadPoolExecutor(self.parallel) as pool:
            found = list(pool.map(lambda j: self._score(ready, target, *j), jobs))
        per = self.splits
        return [(p, float(np.mean(found[i * per : (i + 1) * per]))) for i, p in enumerate(drawn)]

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> FittedTrees:
        best, _ = min(self.scores(train, target, features), key=lambda x: x[1])
        ready = _assembled(train, features).select("__x", F.col(target).cast("double"))
        return FittedTrees(self._estimator(target, best).fit(ready), tuple(features))


def _flat(window: str):
    return array_to_vector(F.transform(F.flatten(window), lambda v: v.cast("double")))


@dataclass(frozen=True)
class FittedWindows:
    model: object
    scale: Moments
    features: tuple[str, ...]
    lookback: int

    def predict(self, rows: DataFrame, series: Sequence[str] = ("series_id",)) -> DataFrame:
        s = self.scale
        scaled = {f"__{c}": standardised(c, s) for c in self.features}
        windows = lookback_windows(
            rows.withColumns(scaled), [f"__{c}" for c in self.features], self.lookback, series=series
        )
        scored = self.model.transform(windows.withColumn("__x", _flat("window")))
        z = unstandardise("__z", *s["__y"])
        return scored.withColumn("yhat", inverse_signed_log1p(z)).drop(
            "__x", "__z", "window", "hours", "weekdays", *scaled
        )


@dataclass(frozen=True)
class WindowRegression:
    """Ridge regression on the scaled last ``lookback`` rows of the features.

    Predicts the standardised signed logarithm of the target. Rows whose window is
    not full get no forecast, so scoring needs ``context`` earlier rows.
    """

    lookback: int = 24
    ridge: float = 0.01

    @property
    def context(self) -> int:
        return self.lookback - 1

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> FittedWindows:
        logged = train.withColumn("__y", signed_log1p(target))
        scale = moments(logged, [*features, "__y"])
        rows = standardise(logged, [*features, "__y"], scale)
        windows = lookback_windows(rows, features, self.lookback)
        ready = windows.select(_flat("window").alias("__x"), "__y")
        model = LinearRegression(
            featuresCol="__x", labelCol="__y", predictionCol="__z", regParam=self.ridge
        ).fit(ready)
        return FittedWindows(model, scale, tuple(features), self.lookback)
