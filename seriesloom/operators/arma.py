"""Seasonal models with differences, autoregressive and moving-average terms, one per series.

The series is differenced, w = (1 - B)^d (1 - B^s)^D y, and w is regressed on its own lags,
on lags of its innovations and on columns differenced alike. Innovations are not observed,
so they are estimated first as the residuals of a long autoregression (Hannan and
Rissanen 1982). Both regressions need their rows only through sums of products: two
passes over chunks of rows, whose sums are solved per series in a small matrix. Lags of
multiplicative orders (p, P) are i + s * j for i up to p and j up to P, with free weights.

A fitted model keeps, per series, its weights and the last rows that a forecast reads. The
forecast feeds on itself, so a task rolls out the rows of one forecast after the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import floor_div
from ..session import materialise
from .autoregression import FALLBACK_ROWS, solve
from .chunks import CHUNK_ROWS, over_chunks
from .positions import attach_balanced

# Orders of the plain model and of the one with exogenous columns.
SARIMA_ORDER, SARIMA_SEASONAL = (1, 1, 1), (1, 1, 1, 24)
SARIMAX_ORDER, SARIMAX_SEASONAL = (2, 0, 1), (1, 1, 0, 24)
#: Lags of the long autoregression beyond those of the model, within a season and in seasons.
LONGER = (4, 1)


def difference_weights(d: int, seasons: int, season: int) -> dict[int, float]:
    """Weights by lag of (1 - B)^d (1 - B^season)^seasons."""
    weights = {0: 1.0}
    for step in [1] * d + [season] * seasons:
        moved: dict[int, float] = {}
        for lag, w in weights.items():
            moved[lag] = moved.get(lag, 0.0) + w
            moved[lag + step] = moved.get(lag + step, 0.0) - w
        weights = {lag: w for lag, w in sorted(moved.items()) if w}
    return weights


def order_lags(within: int, seasons: int, season: int) -> tuple[int, ...]:
    return tuple(sorted({i + season * j for i in range(within + 1) for j in range(seasons + 1)} - {0}))


def _dot(weights: Column, values: Sequence[Column]) -> Column:
    return sum((weights[i] * v for i, v in enumerate(values)), F.lit(0.0))


def _regression(rows: DataFrame, regressors: list[str]) -> DataFrame:
    """(series_id, weights, problem) of ``w`` on a constant and ``regressors``, per series.

    Only rows in which everything is known count; ``problem`` says why there are no weights.
    """
    values = [F.col("w"), F.lit(1.0), *[F.col(c) for c in regressors]]
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    cells = list(combinations_with_replacement(range(len(values)), 2))
    sums = rows.where(known).groupBy("series_id").agg(
        F.array(*[F.sum(values[i] * values[j]) for i, j in cells]).alias("products"), F.count(F.lit(1)).alias("rows")
    )
    kind = rows.schema["series_id"].dataType.simpleString()

    def solved(batches):
        for batch in batches:
            found, why = [], []
            for products, size in zip(batch["products"], batch["rows"], strict=True):
                try:
                    weights = solve(np.asarray(products, dtype=float), int(size))
                    if not np.isfinite(weights).all():
                        raise ValueError("weights are not finite")
                    found.append(weights.tolist())
                    why.append(None)
                except (ValueError, np.linalg.LinAlgError) as problem:
                    found.append(None)
                    why.append(str(problem))
            yield pd.DataFrame({"series_id": batch["series_id"], "weights": found, "problem": why})

    return sums.mapInPandas(solved, f"series_id {kind}, weights array<double>, problem string")


def _lagged(w, column: str, lags: Sequence[int]) -> dict[str, Column]:
    return {f"{column}_{k}": F.lag(column, k).over(w) for k in lags}


def roll_out(
    weights: np.ndarray, last: dict[str, np.ndarray], x: np.ndarray, model: SeasonalArma, steps: int
) -> np.ndarray:
    """Forecasts of ``steps`` steps after the rows in ``last`` (y, w, e, x); later innovations are zero."""
    ar, ma, poly = model.ar_lags, model.ma_lags, model.poly
    own, shocks = weights[1 : 1 + len(ar)], weights[1 + len(ar) : 1 + len(ar) + len(ma)]
    beta = weights[1 + len(ar) + len(ma) :]
    known = len(last["y"])
    columns = np.vstack([last["x"], x]) if x.shape[1] else np.zeros((known + steps, 0))
    change = sum(c * columns[known - lag : known - lag + steps] for lag, c in poly.items())
    drift = weights[0] + change @ beta
    y, w, e = list(last["y"]), list(last["w"]), list(last["e"])
    for step in range(steps):
        value = drift[step] + sum(a * w[-k] for a, k in zip(own, ar)) + sum(m * e[-k] for m, k in zip(shocks, ma))
        y.append(value - sum(c * y[-lag] for lag, c in poly.items() if lag))
        w.append(value)
        e.append(0.0)
    return np.array(y[known:])


@dataclass(frozen=True)
class FittedArma:
    """Weights and last rows per series; ``state`` has a row per series, at its first position after the fit."""

    state: DataFrame
    model: SeasonalArma
    features: tuple[str, ...]

    def predict(self, rows: DataFrame, series: Sequence[str] = ("series_id",)) -> DataFrame:
        """``rows`` with ``yhat``: those that follow the fit without a gap, in each of the ``series``.

        Rows before the fit's end, or behind a gap, have none. A series that could not be
        fitted gets the mean of its last known values; so does one whose forecast is not finite.
        """
        model, names = self.model, list(self.features)
        keys = list(series)
        joined = rows.join(
            self.state.withColumnsRenamed({"series_id": "__series", "pos": "__pos"}),
            (F.col("series_id") == F.col("__series")) & (F.col("pos") == F.col("__pos")), "left",
        ).drop("__series", "__pos")
        schema = T.StructType([*rows.schema.fields, T.StructField("yhat", T.DoubleType())])

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos").combine_chunks()
            yhat = np.full(len(table), np.nan)
            states = table["__state"]
            start = next((i for i in range(len(table)) if states[i].is_valid), None)
            if start is not None:
                state = states[start].as_py()
                pos = table["pos"].to_numpy()[start:]
                steps = int(np.argmin(np.append(pos == pos[0] + np.arange(len(pos)), False)))
                x = [table[c].to_numpy()[start : start + steps].astype(float) for c in names]
                yhat[start : start + steps] = _path(state, np.column_stack(x) if x else np.zeros((steps, 0)), model, steps)
            out = table.drop_columns(["__state"])
            return out.append_column("yhat", pa.array(yhat, pa.float64(), from_pandas=True))

        return joined.groupBy(*keys).applyInArrow(run, schema)


def _path(state: dict, x: np.ndarray, model: SeasonalArma, steps: int) -> np.ndarray:
    fallback = np.nan if state["fallback"] is None else state["fallback"]
    if state["weights"] is not None:
        last = {c: np.array([np.nan if v is None else v for v in state[c]], dtype=float) for c in ("y", "w", "e")}
        last["x"] = np.array(state["x"], dtype=float).reshape(len(last["y"]), -1)
        path = roll_out(np.array(state["weights"]), last, x, model, steps)
        if np.isfinite(path).all():
            return path
    return np.full(steps, fallback)


@dataclass(frozen=True)
class SeasonalArma:
    """(p, d, q)(P, D, Q, s) with free weights, behind the protocol of the forecasters.

    ``features`` of a fit are its exogenous columns; their values must be known for the
    rows of a forecast.
    """

    order: tuple[int, int, int] = SARIMA_ORDER
    seasonal: tuple[int, int, int, int] = SARIMA_SEASONAL
    longer: tuple[int, int] = LONGER
    chunk_rows: int = CHUNK_ROWS
    context: int = 0

    @property
    def poly(self) -> dict[int, float]:
        return difference_weights(self.order[1], self.seasonal[1], self.seasonal[3])

    @property
    def ar_lags(self) -> tuple[int, ...]:
        return order_lags(self.order[0], self.seasonal[0], self.seasonal[3])

    @property
    def ma_lags(self) -> tuple[int, ...]:
        return order_lags(self.order[2], self.seasonal[2], self.seasonal[3])

    @property
    def long_lags(self) -> tuple[int, ...]:
        within, seasons = self.longer
        return order_lags(
            max(self.order[0], self.order[2]) + within, max(self.seasonal[0], self.seasonal[2]) + seasons, self.seasonal[3]
        )

    @property
    def reach(self) -> int:
        """Rows before a forecast that it reads."""
        return max([*self.poly, *self.ar_lags, *self.ma_lags, 1])

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> FittedArma:
        """Weights of every series by two regressions; ``train`` has positions without gaps."""
        poly, size = self.poly, len(features)
        known = {"y": F.nanvl(F.col(target).cast("double"), F.lit(None))}
        known |= {f"x{i}": F.nanvl(F.col(c).cast("double"), F.lit(None)) for i, c in enumerate(features)}
        rows = train.select("series_id", "pos", *[v.alias(c) for c, v in known.items()])

        def differenced(w):
            def of(c):
                return sum(weight * (F.lag(c, lag).over(w) if lag else F.col(c)) for lag, weight in poly.items())

            return {"w": of("y")} | {f"d{i}": of(f"x{i}") for i in range(size)}

        chunk = dict(chunk_rows=self.chunk_rows)
        changes = [f"d{i}" for i in range(size)]
        rows = materialise(over_chunks(rows, differenced, before=max(max(poly), 1), **chunk))
        if self.ma_lags:
            lags = self.long_lags
            wide = over_chunks(rows, lambda w: _lagged(w, "w", lags), before=max(lags), **chunk)
            names = [*[f"w_{k}" for k in lags], *changes]
            first = _regression(wide, names).select("series_id", F.col("weights").alias("__b"))
            bucket = floor_div(F.col("pos"), self.chunk_rows)
            wide = attach_balanced(wide, first, keys=["series_id"], bucket=bucket, how="left")
            fitted = _dot(F.col("__b"), [F.lit(1.0), *[F.col(c) for c in names]])
            rows = materialise(wide.withColumn("e", F.col("w") - fitted).drop("__b", *[f"w_{k}" for k in lags]))
        else:
            rows = rows.withColumn("e", F.lit(0.0))
        reach = self.reach
        wide = over_chunks(
            rows, lambda w: _lagged(w, "w", self.ar_lags) | _lagged(w, "e", self.ma_lags), before=reach, **chunk
        )
        regressors = [*[f"w_{k}" for k in self.ar_lags], *[f"e_{k}" for k in self.ma_lags], *changes]
        weights = _regression(wide, regressors)
        return FittedArma(materialise(self._state(rows, weights, size)), self, tuple(features))

    def _state(self, rows: DataFrame, weights: DataFrame, size: int) -> DataFrame:
        """(series_id, pos, __state) with the last rows of each series and its weights."""
        ends = rows.groupBy("series_id").agg((F.max("pos") + 1).alias("__end"))
        bucket = floor_div(F.col("pos"), self.chunk_rows)
        placed = attach_balanced(rows, ends, keys=["series_id"], bucket=bucket)
        kept = max(self.reach, FALLBACK_ROWS)
        x = F.array(*[F.col(f"x{i}") for i in range(size)]) if size else F.array().cast("array<double>")
        # As many rows per series as a forecast reads.
        tails = placed.where(F.col("pos") >= F.col("__end") - kept).groupBy("series_id", "__end").agg(
            F.sort_array(F.collect_list(F.struct("pos", "y", "w", "e", x.alias("x")))).alias("t")
        )
        recent = F.filter(F.slice("t", -F.least(F.lit(FALLBACK_ROWS), F.size("t")), FALLBACK_ROWS)["y"], lambda v: v.isNotNull())
        mean = F.when(F.size(recent) > 0, F.aggregate(recent, F.lit(0.0), lambda a, b: a + b) / F.size(recent))
        everything = rows.groupBy("series_id").agg(F.avg("y").alias("__mean"))
        state = F.struct(
            "weights", "problem", F.coalesce(mean, F.col("__mean")).alias("fallback"),
            *[F.col(f"t.{c}").alias(c) for c in ("y", "w", "e")], F.flatten("t.x").alias("x"),
        )
        return (
            tails.join(everything, "series_id").join(weights, "series_id", "left")
            .select("series_id", F.col("__end").alias("pos"), state.alias("__state"))
        )
