import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.autoregression import roll_out, seasonal_autoregression
from seriesloom.operators.backtest import block_backtest, failures, unfit_series, walk_forward
from seriesloom.operators.baselines import baseline_predictions
from seriesloom.operators.boosting import Booster, boost
from seriesloom.operators.folds import (
    block_rows,
    fold_bounds,
    fold_table,
    holdout,
    lookback_windows,
    test_rows as rows_under_test,
)
from seriesloom.operators.forecasters import (
    CrossValidatedBoosting,
    GradientBoosting,
    RandomSearch,
    WindowRegression,
    exogenous_columns,
)
from seriesloom.operators.importance import permutation_importance, top_importance, window_importance
from seriesloom.operators.metrics import (
    accuracy,
    common_timestamps,
    fold_mean,
    fold_summary,
    model_coverage,
    pooled_ranking,
    prediction_health,
    walk_forward_ranking,
)
from seriesloom.operators.positions import with_positions
from seriesloom.session import materialise

from .data import collected, panel, spark_panel


@pytest.fixture(scope="module")
def placed(spark):
    return materialise(with_positions(spark_panel(spark, panel(hours=260))))


def brute_folds(n, h, s):
    return [(n - (s - i) * h, n - (s - i - 1) * h) for i in range(s)]


def test_fold_table_matches_expanding_splits(placed):
    got = fold_table(placed, [24], 5, context=5).toPandas()
    for series, g in got.groupby("series_id"):
        n = int(g.n.iloc[0])
        for fold, (a, b) in enumerate(brute_folds(n, 24, 5)):
            part = g[g.fold == fold]
            assert sorted(part[part.role == "test"].pos) == list(range(a, b))
            assert sorted(part[part.role == "train"].pos) == list(range(a))
            assert sorted(part[part.is_context].pos) == list(range(a - 5, a))
    bounds = collected(fold_bounds(placed, [24], 5), "series_id", "fold")
    sizes = got.groupby("series_id").n.first()
    assert (bounds.test_rows == 24).all() and len(bounds) == 10
    for r in bounds.itertuples():
        assert r.train_rows == brute_folds(sizes[r.series_id], 24, 5)[r.fold][0]


def test_short_series_are_left_out(placed):
    sizes = {r.series_id: r.n for r in placed.select("series_id", "n").distinct().collect()}
    h = min(sizes.values()) // 6
    assert {r.series_id for r in rows_under_test(placed, [h], 5).select("series_id").distinct().collect()} == {
        s for s, n in sizes.items() if n > h * 6
    }
    assert rows_under_test(placed, [1000], 5).count() == 0
    assert block_rows(placed, 24, 5).count() == 24 * 5 * 2


def test_holdout_cuts(placed):
    rows = holdout(placed).toPandas()
    windows = holdout(placed, lookback=10).toPandas()
    for s, g in rows.groupby("series_id"):
        n = len(g)
        assert (g.role == "train").sum() == int(n * 0.9)
        w = windows[windows.series_id == s]
        assert (w.role == "valid").sum() == max(1, int(0.1 * (n - 9))) and w.role.isna().sum() == 9


def test_lookback_windows(placed):
    got = collected(lookback_windows(placed, ["price", "load"], 6, chunk_rows=20), "series_id", "pos")
    whole = collected(placed, "series_id", "pos")
    for _, r in got.groupby("series_id").tail(3).iterrows():
        part = whole[(whole.series_id == r.series_id) & (whole.pos > r.pos - 6) & (whole.pos <= r.pos)]
        np.testing.assert_allclose(np.array(list(map(list, r.window))), part[["price", "load"]], rtol=1e-6)
        assert list(r.hours) == part.ts.dt.hour.tolist() and list(r.weekdays) == part.ts.dt.dayofweek.tolist()
    assert got.pos.min() == 5
    assert lookback_windows(placed, ["price"], 6, keep_short=True).where("window IS NULL").count() == 10


def test_baselines_match_brute_force(placed):
    got = baseline_predictions(placed, "price", [10, 30], 4, chunk_rows=30).toPandas()
    whole = collected(placed, "series_id", "pos")
    for (s, h, fold), g in got.groupby(["series_id", "horizon", "fold"]):
        y = whole[whole.series_id == s].price.to_numpy()
        a, b = brute_folds(len(y), h, 4)[fold]
        for model, want in (
            ("persistence", y[a - 1 : b - 1]), ("seasonal_naive", y[a - 24 : b - 24]),
            ("mean24", np.full(h, y[a - 24 : a].mean())),
        ):
            part = g[g.model == model].sort_values("ts")
            np.testing.assert_allclose(part.yhat, want)
            np.testing.assert_allclose(part.y, y[a:b])


def test_mean_baseline_falls_back_to_all_training_rows(spark):
    pdf = panel(series=1, hours=200, gap=0)
    pdf.loc[100:170, "price"] = np.nan
    df = spark_panel(spark, pdf).withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    got = baseline_predictions(with_positions(df), "price", [30], 1).where("model = 'mean24'")
    assert got.first().yhat == pytest.approx(pdf.price[:100].mean())


def test_metric_flavours(spark):
    rows = [("m", 0.0, 1.0), ("m", -2.0, -1.0), ("m", 4.0, 5.0), ("n", 3.0, None), ("n", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "model string, y double, yhat double")
    strict = {r.model: r for r in accuracy(df, ["model"]).collect()}
    m = strict["m"]
    assert (m.MAE, m.RMSE) == (1.0, 1.0) and m.MAPE == pytest.approx((1 / 1e-9 + 0.5 + 0.25) / 3 * 100)
    assert m.RMSLE == pytest.approx(np.sqrt((np.log1p(1) ** 2 + 0 + (np.log(6) - np.log(5)) ** 2) / 3))
    assert m.R2 == pytest.approx(1 - 3 / np.var([0, -2, 4]) / 3)
    assert strict["n"].MAE is None and strict["n"].R2 is None
    safe = {r.model: r for r in accuracy(df, ["model"], null_safe=True).collect()}
    assert safe["m"].MAPE == pytest.approx((0.5 + 0.25) / 2 * 100)
    assert safe["n"].MAE == 0.0 and safe["n"].R2 is None
    constant = spark.createDataFrame([("p", 2.0, 2.0), ("p", 2.0, 2.0), ("q", 2.0, 1.0), ("q", 2.0, 2.0)], df.schema)
    r2 = {r.model: r.R2 for r in accuracy(constant, ["model"]).collect()}
    assert r2 == {"p": 1.0, "q": 0.0}


def test_fold_means_and_summary(spark):
    rows = [("m", 0, 1.0), ("m", 1, None), ("m", 2, 3.0), ("k", 0, 2.0)]
    df = spark.createDataFrame(rows, "model string, fold int, MAE double")
    assert {r.model: r.MAE for r in fold_mean(df, ["model"], ["MAE"]).collect()} == {"m": None, "k": 2.0}
    assert {r.model: r.MAE for r in fold_mean(df, ["model"], ["MAE"], skip_null=True).collect()} == {"m": 2.0, "k": 2.0}
    got = fold_summary(df, ["model"], ["MAE"]).where("model = 'm'").first()
    assert got.folds.MAE == [1.0, None, 3.0] and got.n_folds == 3


def test_prediction_reports(placed):
    found = materialise(baseline_predictions(placed, "price", [24], 3))
    ranked = pooled_ranking(found).toPandas()
    assert sorted(ranked["rank"].unique()) == [1, 2, 3]
    assert walk_forward_ranking(found).count() == 6
    gaps = found.withColumn("yhat", F.when((F.col("model") != "mean24") | (F.hour("ts") < 5), F.col("yhat")))
    assert {r.model for r in model_coverage(gaps).collect()} == {"persistence", "seasonal_naive"}
    assert prediction_health(gaps, ["model"]).where("model = 'mean24'").first().missing > 0
    fewer = found.where("NOT (model = 'mean24' AND (hour(ts) = 3 OR series_id = 's1'))")
    kept = common_timestamps(fewer, 3).toPandas()
    assert (kept[kept.series_id == "s0"].groupby("ts").model.nunique() == 3).all()
    assert len(kept[kept.series_id == "s1"]) == fewer.where("series_id = 's1'").count()


def test_roll_out_continues_a_seasonal_pattern():
    t = np.arange(400)
    y = 10 + np.sin(2 * np.pi * t / 24) + 0.01 * t
    got = roll_out(np.array([0.0, 1.0]), y[:350], np.zeros((400, 0)), 50, (1,), 24)
    np.testing.assert_allclose(got, y[350:], atol=1e-9)


def test_seasonal_autoregression_groups_and_fallback(placed):
    got = seasonal_autoregression(placed, "price", [24], 2, exogenous=["load"], lags=(1, 2, 24)).toPandas()
    assert len(got) == 2 * 2 * 24 and got.yhat.notna().all() and got.error.isna().all()
    short = seasonal_autoregression(placed, "price", [24], 2, lags=(1, 235)).toPandas()
    whole = collected(placed, "series_id", "pos")
    for (s, fold), g in short.groupby(["series_id", "fold"]):
        y = whole[whole.series_id == s].price.to_numpy()
        start = len(y) - 24 * (2 - fold)
        assert g.error.notna().all()
        np.testing.assert_allclose(g.yhat, y[start - 24 : start].mean())


def test_seasonal_autoregression_uses_the_whole_history(spark):
    """Equal to a solve on all rows of 20000, whose older half behaves differently."""
    n, h, splits, lags, season = 20_000, 24, 2, (1, 24), 24
    rng = np.random.default_rng(4)
    x, noise = rng.normal(size=n), rng.normal(size=n)
    y = 5 * x + np.convolve(noise, [1, 0.6, 0.3])[:n]
    y[: n // 2] = -3 * x[: n // 2] + noise[: n // 2]
    frame = pd.DataFrame({"series_id": "a", "pos": np.arange(n), "n": n, "price": y, "load": x})
    df = spark.createDataFrame(frame).withColumn("ts", F.timestamp_seconds(F.col("pos") * 3600))
    got = seasonal_autoregression(df, "price", [h, 48], splits, exogenous=["load"], lags=lags, season=season)
    got = got.where(f"horizon = {h}").orderBy("ts").toPandas()
    z, u = y[season:] - y[:-season], x[season:] - x[:-season]
    for fold in range(splits):
        start = n - h * (splits - fold)
        at = np.arange(max(lags), start - season)
        design = np.column_stack([np.ones(len(at)), *[z[at - k] for k in lags], u[at]])
        w = np.linalg.lstsq(design, z[at], rcond=None)[0]
        path = list(y[:start])
        for i in range(start, start + h):
            gaps = [path[i - k] - path[i - k - season] for k in lags]
            path.append(path[i - season] + w[0] + np.dot(w[1:3], gaps) + w[3] * (x[i] - x[i - season]))
        np.testing.assert_allclose(got[got.fold == fold].yhat, path[start:], rtol=1e-6, atol=1e-6)
    assert got.error.isna().all() and len(got) == splits * h


FEATURES = ["hour", "lag1", "load"]


@pytest.fixture(scope="module")
def model_rows(placed):
    w = placed.withColumn("hour", F.hour("ts").cast("double"))
    lagged = w.join(
        w.select("series_id", (F.col("pos") + 1).alias("pos"), F.col("price").alias("lag1")), ["series_id", "pos"]
    ).withColumns({"pos": F.col("pos") - 1, "n": F.col("n") - 1})
    return materialise(lagged.select("series_id", "ts", "pos", "n", "price", *FEATURES))


def test_models_beat_nothing_and_keep_row_counts(model_rows):
    models = {
        "GBR": GradientBoosting(max_rounds=8, learning_rate=0.3, min_leaf=3),
        "WIN": WindowRegression(lookback=4),
    }
    found = walk_forward(model_rows, models, "price", FEATURES, [24], 2).toPandas()
    assert len(found) == 2 * 2 * 2 * 24 and found.yhat.notna().all()
    naive = found.y.std()
    errors = (found.y - found.yhat).abs().groupby(found.model).mean()
    assert (errors < naive).all()


def plain_rows(model_rows):
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(model_rows)
    return materialise(
        ready.select("__x", F.col("price").alias("__y"), (F.col("pos") >= F.col("n") - 40).alias("__valid"))
    )


def test_boosting_adds_trees_to_residuals_and_stops(model_rows):
    rows = plain_rows(model_rows)
    booster = Booster(rows, rate=0.5, seed=1, maxDepth=3)
    best = boost([booster], 40, 3)
    # Patience ends the fit: no more rounds than the best and the wait.
    assert len(booster.trees) == len(booster.errors) <= best + 3 < 40
    assert booster.errors[best - 1] == min(booster.errors) and booster.errors[0] > min(booster.errors)
    scored = booster.model(best).transform(rows.where("__valid")).toPandas()
    error = (scored["__y"] - booster.base - scored["__above"]).abs().mean()
    assert error == pytest.approx(booster.errors[best - 1])
    trained = rows.where("NOT __valid").agg(F.avg("__y")).first()[0]
    assert booster.base == pytest.approx(trained)
    # Without valid rows there is no error and no early end; deep trees at full rate leave little.
    other = Booster(rows.drop("__valid"), rate=1.0, seed=1, maxDepth=10, featureSubsetStrategy="all")
    before = other.rows.agg(F.avg(F.abs("__rest"))).first()[0]
    assert boost([other], 2, None) == 1 and len(other.trees) == 2 and other.errors == [None, None]
    assert other.rows.agg(F.avg(F.abs("__rest"))).first()[0] < 0.3 * before


def test_folds_of_boosting_stop_together(model_rows):
    rows = plain_rows(model_rows)
    folds = [Booster(rows, rate=0.5, seed=s, maxDepth=2) for s in (1, 2)]
    best = boost(folds, 30, 2)
    mean = np.mean([f.errors for f in folds], axis=0)
    assert len({len(f.errors) for f in folds}) == 1 and len(mean) <= best + 2
    assert best == int(np.argmin(mean)) + 1
    with pytest.raises(ValueError):
        Booster(rows.limit(0), rate=0.1, seed=1)


def test_bad_series_do_not_spoil_the_fits_of_others(model_rows):
    broken = model_rows.withColumn(
        "load", F.when((F.col("series_id") == "s1") & (F.col("pos") == 150), float("inf")).otherwise(F.col("load"))
    )
    models = {"GBR": GradientBoosting(max_rounds=3, learning_rate=0.5, min_leaf=3)}
    found = materialise(block_backtest(broken, models, "price", FEATURES, block=24, blocks=3))
    alone = block_backtest(model_rows.where("series_id = 's0'"), models, "price", FEATURES, block=24, blocks=3)
    got, want = found.toPandas(), collected(alone, "ts")
    sizes = {r.series_id: r.n for r in model_rows.select("series_id", "n").distinct().collect()}
    s1 = got[got.series_id == "s1"]
    spoilt = s1.fold.map(lambda f: sizes["s1"] - 24 * (3 - f) > 150)
    assert s1[spoilt].yhat.isna().all() and s1[spoilt].error.eq("infinite value of load").all() and spoilt.any()
    assert s1[~spoilt].yhat.notna().all() and s1[~spoilt].error.isna().all()
    late = got[(got.series_id == "s0") & got.fold.isin(s1[spoilt].fold)].sort_values("ts")
    np.testing.assert_allclose(late.yhat, want[want.fold.isin(late.fold)].yhat)
    table = failures(found).toPandas()
    assert table.rows.sum() == spoilt.sum() and set(table.series_id) == {"s1"}
    ranked = pooled_ranking(found).toPandas().set_index("series_id")
    assert ranked.n_failed["s1"] == spoilt.sum() and ranked.n_rows["s0"] == 72 and ranked.n_failed["s0"] == 0
    empty = model_rows.withColumn("price", F.when(F.col("series_id") == "s0", F.col("price")))
    faults = unfit_series(empty, "price", FEATURES).collect()
    assert [(r.series_id, r["__unfit"]) for r in faults] == [("s1", "no complete row")]


def test_cross_validated_rounds_and_random_search(model_rows):
    small = {"stepSize": 0.3, "maxDepth": 2}
    cv = CrossValidatedBoosting(max_rounds=3, folds=2, search=small, final=small)
    assert walk_forward(model_rows, {"XGB": cv}, "price", FEATURES, [24], 1).count() == 48
    search = RandomSearch(grid={"maxIter": (1, 3), "maxDepth": (2, 3)}, draws=3, splits=1, horizon=24)
    assert len(search.settings()) == 3 and search.settings() == search.settings()
    scores = search.scores(model_rows, "price", FEATURES)
    assert all(np.isfinite(s) for _, s in scores)


class Broken:
    context = 0

    def fit(self, train, target, features):
        raise ValueError("no fit today")


def test_block_backtest_isolates_failures(model_rows):
    found = block_backtest(model_rows, {"bad": Broken()}, "price", FEATURES, block=24, blocks=2).toPandas()
    assert len(found) == 2 * 2 * 24 and found.yhat.isna().all() and found.error.eq("no fit today").all()
    with pytest.raises(ValueError):
        walk_forward(model_rows, {"bad": Broken()}, "price", FEATURES, [24], 1)


class UsesLag:
    """Predicts the lagged price, so only ``lag1`` matters."""

    context = 0

    def fit(self, train, target, features):
        return self

    def predict(self, rows, series=("series_id",)):
        return rows.withColumn("yhat", F.col("lag1"))


@pytest.mark.parametrize("window", [48, None])
def test_permutation_moves_only_the_used_feature(model_rows, window):
    got = {
        r.feature: r.importance
        for r in permutation_importance(model_rows, UsesLag(), "price", FEATURES, window=window, repeats=3).collect()
    }
    assert got["lag1"] > 1.0 and abs(got["hour"]) < 1e-9 and abs(got["load"]) < 1e-9
    per_series = permutation_importance(
        model_rows, UsesLag(), "price", FEATURES, window=window, repeats=1, by=["series_id"]
    )
    assert per_series.count() == 6
    assert top_importance(per_series, 1, by=["series_id"]).count() == 2


def test_window_importance_keeps_context(model_rows):
    model = WindowRegression(lookback=4)
    fitted = model.fit(model_rows.where("pos < n - 48"), "price", FEATURES)
    got = window_importance(fitted, model_rows, "price", FEATURES, context=3, window=48, repeats=2).toPandas()
    assert set(got.feature) == set(FEATURES) and got.importance.notna().all()
    assert pd.Series(got.importance.values, got.feature).idxmax() in ("lag1", "load")


def test_exogenous_selection(model_rows):
    assert exogenous_columns(model_rows, "price", ["hour", "pos", "n"]) == ["lag1", "load"]
