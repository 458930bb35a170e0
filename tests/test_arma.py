"""Seasonal models with moving-average terms, and their permutation importance, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.permute import round_keys
from seriesloom.operators.arma import (
    SARIMA_ORDER,
    SARIMA_SEASONAL,
    SARIMAX_ORDER,
    SARIMAX_SEASONAL,
    SeasonalArma,
    difference_weights,
    order_lags,
)
from seriesloom.operators.backtest import walk_forward
from seriesloom.operators.importance import permutation_importance


def test_polynomials_and_lags():
    assert difference_weights(0, 0, 24) == {0: 1.0}
    assert difference_weights(1, 1, 24) == {0: 1.0, 1: -1.0, 24: -1.0, 25: 1.0}
    assert difference_weights(2, 0, 24) == {0: 1.0, 1: -2.0, 2: 1.0}
    assert order_lags(2, 1, 24) == (1, 2, 24, 25, 26) and order_lags(0, 0, 24) == ()


def plain_fit(y, x, model):
    """Weights and the series that a forecast reads, by regressions on whole arrays."""
    n, poly = len(y), model.poly

    def differenced(v):
        out = np.full(n, np.nan)
        top = max(poly)
        out[top:] = sum(c * v[top - lag : n - lag] for lag, c in poly.items())
        return out

    def lagged(v, k):
        return np.concatenate([np.full(k, np.nan), v[:-k]])

    w, d = differenced(y), [differenced(c) for c in x]

    def regress(columns):
        design = np.column_stack([np.ones(n), *columns])
        whole = ~np.isnan(design).any(axis=1) & ~np.isnan(w)
        return np.linalg.lstsq(design[whole], w[whole], rcond=None)[0], design

    e = np.zeros(n)
    if model.ma_lags:
        b, design = regress([*[lagged(w, k) for k in model.long_lags], *d])
        e = w - design @ b
    b, _ = regress([*[lagged(w, k) for k in model.ar_lags], *[lagged(e, k) for k in model.ma_lags], *d])
    return b, w, e


def plain_forecast(y, x, future, model, steps):
    b, w, e = plain_fit(y, x, model)
    w, e, y = list(w), list(e), list(y)
    x = [np.concatenate([past, new]) for past, new in zip(x, future, strict=True)]
    for _ in range(steps):
        t = len(y)
        change = [sum(c * v[t - lag] for lag, c in model.poly.items()) for v in x]
        terms = [1.0, *[w[t - k] for k in model.ar_lags], *[e[t - k] for k in model.ma_lags], *change]
        value = float(np.dot(b, terms))
        y.append(value - sum(c * y[t - lag] for lag, c in model.poly.items() if lag))
        w.append(value)
        e.append(0.0)
    return np.array(y[-steps:])


def made(n, seed, season=24):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = rng.normal(size=n)
    noise = rng.normal(size=n)
    shock = noise + 0.5 * np.concatenate([[0], noise[:-1]])
    y = 1e4 + 0.01 * t + 5 * np.sin(2 * np.pi * t / season) + 2 * x
    for i in range(1, n):
        shock[i] += 0.6 * shock[i - 1]
    return y + shock, x


def frame(spark, parts):
    pdf = pd.concat(
        [
            pd.DataFrame({"series_id": s, "pos": np.arange(len(y)), "n": len(y), "price": y, "load": x})
            for s, (y, x) in parts.items()
        ]
    )
    return spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds(F.col("pos") * 3600))


@pytest.mark.parametrize("chunk_rows", [100, 4096])
@pytest.mark.parametrize(
    ("order", "seasonal", "columns"),
    [
        (SARIMA_ORDER, SARIMA_SEASONAL, []),
        (SARIMAX_ORDER, SARIMAX_SEASONAL, ["load"]),
        ((1, 0, 0), (0, 1, 0, 24), ["load"]),
        ((0, 1, 2), (0, 0, 0, 24), []),
    ],
)
def test_forecasts_equal_plain_regressions(spark, order, seasonal, columns, chunk_rows):
    parts = {"a": made(900, 1), "b": made(700, 2)}
    model = SeasonalArma(order, seasonal, chunk_rows=chunk_rows)
    got = walk_forward(frame(spark, parts), {"M": model}, "price", columns, [48], 2).toPandas()
    assert len(got) == 2 * 2 * 48 and got.error.isna().all()
    for (s, fold), g in got.groupby(["series_id", "fold"]):
        y, x = parts[s]
        start = len(y) - 48 * (2 - fold)
        past, future = ([x[:start]], [x[start : start + 48]]) if columns else ([], [])
        want = plain_forecast(y[:start], past, future, model, 48)
        np.testing.assert_allclose(g.sort_values("ts").yhat, want, rtol=1e-7)


def test_series_that_cannot_be_fitted_get_a_mean(spark):
    y, x = made(400, 3)
    gap = y.copy()
    gap[-30] = np.nan
    df = frame(spark, {"a": (y, x), "short": (y[:60], x[:60]), "gap": (gap, x)})
    df = df.withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    model = SeasonalArma(SARIMAX_ORDER, SARIMAX_SEASONAL)
    fitted = model.fit(df.where("pos < n - 10"), "price", ["load"])
    got = fitted.predict(df.where("pos >= n - 12")).toPandas().set_index(["series_id", "pos"]).sort_index()
    assert got.loc["a"].yhat.isna().sum() == 2 and got.loc["a"].yhat.notna().sum() == 10
    short = got.loc["short"].yhat.dropna()
    np.testing.assert_allclose(short, y[26:50].mean())
    known = gap[400 - 34 : 390]
    np.testing.assert_allclose(got.loc["gap"].yhat.dropna(), known[~np.isnan(known)].mean())


def shuffled(size, keys):
    """The permutation of ``shuffled_place`` as a loop."""
    prime, out = 2**31 - 1, []
    for x in range(size):
        for m, a, b in keys:
            image = (m % size - x) % size
            if (max(x, image) % prime * a + b) % prime % 2:
                x = image
        out.append(x)
    return out


def test_importance_of_exogenous_columns(spark):
    """Equal to refitting on the prefix, shuffling in the window and forecasting again."""
    y, x = made(600, 5)
    noise = np.random.default_rng(1).normal(size=600)
    df = frame(spark, {"a": (y, x)}).withColumn("wind", F.element_at(F.array(*[F.lit(float(v)) for v in noise]), (F.col("pos") + 1).cast("int")))
    model, h = SeasonalArma(SARIMAX_ORDER, SARIMAX_SEASONAL), 48
    got = {
        r.feature: r.importance
        for r in permutation_importance(df, model, "price", ["load", "wind"], window=h, repeats=3).collect()
    }
    cut = 600 - h
    past, valid = [x[:cut], noise[:cut]], [x[cut:], noise[cut:]]
    base = np.abs(y[cut:] - plain_forecast(y[:cut], past, valid, model, h)).mean()
    for i, name in enumerate(("load", "wind")):
        errors = []
        for r in range(1, 4):
            moved = np.empty(h)
            moved[shuffled(h, round_keys(42, r))] = valid[i]
            future = [moved if j == i else v for j, v in enumerate(valid)]
            errors.append(np.abs(y[cut:] - plain_forecast(y[:cut], past, future, model, h)).mean())
        assert got[name] == pytest.approx(np.mean(errors) - base, abs=1e-6)
    assert got["load"] > 10 * abs(got["wind"])
