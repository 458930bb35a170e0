import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.stats import (
    newey_west_lags_of,
    normal_two_sided,
    significance_stars,
    student_two_sided,
)
from seriesloom.operators.comparison import diebold_mariano, dm_summary, wide_predictions
from seriesloom.operators.decompose import seasonal_decompose
from seriesloom.operators.peaks import best_peak_models, month_view, peak_metrics, peak_thresholds
from seriesloom.operators.positions import with_positions
from seriesloom.operators.stationarity import adf, adf_p_value, kpss

from .data import START, panel, spark_panel


@pytest.fixture(scope="module")
def forecasts(spark):
    rng = np.random.default_rng(5)
    n = 230
    y = 50 + rng.normal(0, 10, n)
    out = pd.DataFrame({"series_id": "s", "ts": [START + pd.Timedelta(hours=i) for i in range(n)], "y": y})
    for name, spread in (("A", 2), ("B", 4), ("C", 4.2)):
        out[name] = y + np.convolve(rng.normal(0, spread, n + 3), np.ones(4) / 2, "valid")
    return out


def brute_dm(y, a, b, loss):
    f = np.abs if loss == "MAE" else np.square
    d = f(y - a) - f(y - b)
    n, m = len(d), d.mean()
    lags = int(math.floor(4 * (n / 100) ** (2 / 9)))
    c = d - m
    s = c @ c / n + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lags + 1))
    raw = m / math.sqrt(s / n)
    return raw, raw * math.sqrt((n - 1) / n), m, lags


@pytest.mark.parametrize("chunk_rows", [20, 4096])
def test_diebold_mariano_matches_brute_force(spark, forecasts, chunk_rows):
    pdf = forecasts.assign(D=forecasts.A, E=forecasts.B)
    pdf.loc[17, "E"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("E", F.when(~F.isnan("E"), F.col("E")))
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    models = ["B", "A", "C", "D", "E"]
    got = diebold_mariano(df, models, chunk_rows=chunk_rows).toPandas()
    assert len(got) == 20 and list(got[got.loss == "MAE"].pair)[:2] == ["B vs A", "B vs C"]
    for r in got.itertuples():
        a, b = r.pair.split(" vs ")
        if "E" in (a, b) or {a, b} == {"A", "D"}:
            assert r.better == "NA" and math.isnan(r.dm) and math.isnan(r.n)
            continue
        raw, dm, mean, lags = brute_dm(pdf.y.to_numpy(), pdf[a].to_numpy(), pdf[b].to_numpy(), r.loss)
        assert (r.dm_raw, r.dm, r.mean_diff) == pytest.approx((raw, dm, mean))
        assert r.nw_lags == lags == newey_west_lags_of(len(pdf)) and r.better == (a if mean < 0 else b)
        assert r.p_norm == pytest.approx(math.erfc(abs(dm) / math.sqrt(2)))


def plain_variance(d, lags):
    c, n = d - d.mean(), len(d)
    return c @ c / n + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, min(lags, n - 1) + 1))


@pytest.mark.parametrize(
    ("options", "lags", "h"),
    [
        ({"lags": 0}, 0, 1), ({"lags": 9}, 9, 1), ({"lags": 400}, 400, 1), ({"auto_lags": False, "h": 4}, 3, 4),
        ({"auto_lags": False}, 0, 1), ({"lags": 2, "h": 3, "auto_lags": False}, 2, 3), ({"lags": 5, "corrected": False}, 5, 1),
    ],
)
def test_diebold_mariano_options(spark, forecasts, options, lags, h):
    df = spark.createDataFrame(forecasts).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = diebold_mariano(df, ["A", "B"], chunk_rows=50, **options)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    n = len(forecasts)
    for r in found.collect():
        f = np.abs if r.loss == "MAE" else np.square
        d = f((forecasts.y - forecasts.A).to_numpy()) - f((forecasts.y - forecasts.B).to_numpy())
        raw = d.mean() / math.sqrt(plain_variance(d, lags) / n)
        factor = math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) if options.get("corrected", True) else 1.0
        assert (r.dm_raw, r.dm) == pytest.approx((raw, raw * factor)) and (r.nw_lags, r.h) == (lags, h)
        assert (r.p_t is None) == (not options.get("corrected", True)) and r.p_norm is not None
    with pytest.raises(ValueError):
        diebold_mariano(df, ["A"])


def test_too_short_series_have_no_tests(spark, forecasts):
    df = spark.createDataFrame(forecasts.head(4)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert diebold_mariano(df, ["A", "B"]).count() == 0


def test_p_values(spark):
    # Published two-sided points of Student's t and of the normal distribution.
    rows = [(12.706204736, 1), (2.570581836, 5), (2.085963447, 20), (1.962339081, 1000), (0.0, 7)]
    df = spark.createDataFrame(rows, "x double, k int")
    got = df.select(student_two_sided("x", "k").alias("t"), normal_two_sided(F.lit(1.959963985)).alias("z")).collect()
    assert [r.t for r in got] == pytest.approx([0.05, 0.05, 0.05, 0.05, 1.0], abs=1e-8)
    assert got[0].z == pytest.approx(0.05)
    small = df.select(student_two_sided(F.lit(-9.27), F.lit(1679)).alias("p")).first().p
    assert 0 < small < 1e-15
    stars = spark.createDataFrame([(0.0005,), (0.005,), (0.04,), (0.05,), (None,)], "p double")
    assert [r.s for r in stars.select(significance_stars("p").alias("s")).collect()] == ["***", "**", "*", "", ""]


def brute_peaks(y, p, t):
    keep = ~np.isnan(p)
    y, p = y[keep], p[keep]
    peak, called, e = y >= t, p >= t, np.abs(y - p)
    w = np.where(peak, 3.0, 1.0)
    precision, recall = (peak & called).sum() / called.sum(), (peak & called).sum() / peak.sum()
    f1 = 2 * precision * recall / (precision + recall)
    return peak.sum(), e[peak].mean(), e[~peak].mean(), (w * e).sum() / w.sum(), precision, recall, f1


def test_peak_metrics(spark, forecasts):
    pdf = forecasts.copy()
    pdf.loc[5:9, "A"] = np.nan
    pdf["F"] = np.nan
    pdf.loc[:3, "F"] = 1.0
    long = pdf.melt(["series_id", "ts", "y"], ["A", "B", "F"], "model", "yhat")
    df = spark.createDataFrame(long).withColumn("yhat", F.when(~F.isnan("yhat"), F.col("yhat")))
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    limits = peak_thresholds(df.where("model = 'B'"))
    got = peak_metrics(df, limits).toPandas().set_index(["model", "q"])
    for q in (0.95, 0.92, 0.89):
        t = pdf.y.quantile(q)
        for m in ("A", "B"):
            r = got.loc[m, q]
            assert r.threshold == pytest.approx(t)
            want = brute_peaks(pdf.y.to_numpy(), pdf[m].to_numpy(), t)
            assert [r.n_peaks, r.MAE_peaks, r.MAE_nonpeaks, r.WMAE, r.precision_peak, r.recall_peak, r.f1_peak] == (
                pytest.approx(list(want))
            )
        assert got.loc["F", q].n_peaks == 0 and np.isnan(got.loc["F", q].WMAE)
    fixed = peak_metrics(df, peak_thresholds(df, fixed=1e9)).where("model = 'B'").first()
    assert fixed.n_peaks == 0 and fixed.recall_peak is None and fixed.f1_peak is None
    best = best_peak_models(peak_metrics(df, limits), q=0.95)
    assert [r.place for r in best.orderBy("place").collect()] == [1, 2]
    view = month_view(df, best, hours=48).toPandas()
    assert len(view) == 96 and view.is_peak.sum() == 2 * (pdf.y.tail(48) >= pdf.y.quantile(0.95)).sum()


def test_wide_predictions_keep_nulls(spark):
    rows = [("s", START, "A", 1.0, 2.0), ("s", START, "B", 1.0, None)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, model string, y double, yhat double")
    r = wide_predictions(df, ["A", "B"]).first()
    assert (r.y, r.A, r.B) == (1.0, 2.0, None)
    assert "sig" in dm_summary(diebold_mariano(wide_predictions(df, ["A", "B"]), ["A", "B"])).columns


def brute_kpss(y):
    n, e = len(y), y - y.mean()
    cover, s0, s1 = int(n ** (2 / 9)), e @ e / n, 0.0
    for i in range(1, cover + 1):
        p = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + p, s1 + i * p
    lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))
    s = e @ e + sum(2 * (e[i:] @ e[: n - i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return lags, (np.cumsum(e) ** 2).sum() / n**2 / (s / n)


def brute_adf(y, fixed=None):
    n, d = len(y), np.diff(y)
    top = math.ceil(12 * (n / 100) ** 0.25)

    def fit(lag, start):
        t = np.arange(start, n)
        x = np.column_stack([np.ones(t.size), y[t - 1], *[d[t - 1 - k] for k in range(1, lag + 1)]])
        b, *_ = np.linalg.lstsq(x, d[t - 1], rcond=None)
        ssr = ((d[t - 1] - x @ b) ** 2).sum()
        spread = math.sqrt(ssr / (t.size - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        return t.size * math.log(ssr / t.size) + 2 * x.shape[1], b[1] / spread

    lag = fixed if fixed is not None else min(range(top + 1), key=lambda k: fit(k, top + 1)[0])
    return lag, fit(lag, lag + 1)[1]


@pytest.mark.parametrize("chunk_rows", [60, 4096])
def test_stationarity_matches_brute_force(spark, chunk_rows):
    pdf = panel(series=3, hours=420)
    rng = np.random.default_rng(2)
    walk = pdf.series_id == "s1"
    pdf.loc[walk, "price"] = np.cumsum(rng.normal(size=walk.sum())) + 1000
    pdf = pdf[(pdf.series_id != "s2") | (pdf.index % 5 == 0)]  # too short after thinning
    df = spark_panel(spark, pdf)
    a = {r.series_id: r for r in kpss(df, "price", chunk_rows=chunk_rows).collect()}
    b = {r.series_id: r for r in adf(df, "price", chunk_rows=chunk_rows).collect()}
    assert set(a) == set(b) == {"s0", "s1"}
    for s in a:
        y = pdf[pdf.series_id == s].sort_values("ts").price.to_numpy()
        lags, stat = brute_kpss(y)
        assert (a[s].lags, a[s].kpss) == (lags, pytest.approx(stat))
        lag, t = brute_adf(y)
        assert (b[s].used_lag, b[s].adf) == (lag, pytest.approx(t, rel=1e-6))
        assert b[s].nobs == len(y) - 1 - lag and 0 <= b[s].adf_p <= 1
    assert a["s1"].kpss_p < a["s0"].kpss_p and b["s1"].adf_p > b["s0"].adf_p


@pytest.mark.parametrize("lags", [0, 1, 7])
@pytest.mark.parametrize("chunk_rows", [60, 4096])
def test_dickey_fuller_with_a_given_lag(spark, lags, chunk_rows):
    pdf = panel(series=2, hours=300, gap=0)
    pdf["price"] = pdf.price.cumsum() + 1e6
    for r in adf(spark_panel(spark, pdf), "price", lags=lags, chunk_rows=chunk_rows).collect():
        y = pdf[pdf.series_id == r.series_id].price.to_numpy()
        assert (r.used_lag, r.adf) == (lags, pytest.approx(brute_adf(y, lags)[1], rel=1e-6))
        assert r.nobs == len(y) - 1 - lags


def test_stationarity_of_a_constant_series_is_null(spark):
    pdf = panel(series=1, hours=150, gap=0).assign(price=3.0)
    df = spark_panel(spark, pdf)
    assert kpss(df, "price").first().kpss is None
    assert adf(df, "price").first().adf is None


def test_dickey_fuller_p_values():
    # Published 1, 5 and 10 percent points of the constant case.
    assert adf_p_value(-3.43) == pytest.approx(0.01, abs=2e-3)
    assert adf_p_value(-2.86) == pytest.approx(0.05, abs=2e-3)
    assert adf_p_value(-2.57) == pytest.approx(0.10, abs=2e-3)
    assert adf_p_value(3.0) == 1.0 and adf_p_value(-20.0) == 0.0


def test_decomposition_adds_up(spark):
    t = np.arange(200)
    pdf = pd.DataFrame({"series_id": "s", "ts": [START + pd.Timedelta(hours=int(i)) for i in t]})
    pdf["price"] = 5 + 0.1 * t + np.sin(2 * np.pi * t / 24)
    df = with_positions(spark_panel(spark, pdf))
    for chunk in (30, 4096):
        got = seasonal_decompose(df, "price", period=24, chunk_rows=chunk).toPandas().sort_values("pos")
        inner = got[got.trend.notna()]
        assert len(got) == 200 and len(inner) == 200 - 24
        np.testing.assert_allclose(inner.trend, 5 + 0.1 * inner.pos, atol=1e-9)
        np.testing.assert_allclose(inner.seasonal, np.sin(2 * np.pi * inner.pos / 24), atol=1e-9)
        assert abs(inner.resid).max() < 1e-9
    assert seasonal_decompose(df, "price", period=168).count() == 0
