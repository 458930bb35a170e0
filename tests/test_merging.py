import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.merge import (
    coerce_columns,
    merge_blocks,
    merge_forecasts,
    side_by_side,
    sort_rankings,
    union_rankings,
)
from seriesloom.operators.ranking import (
    fuse,
    metric_table,
    model_weights,
    rank_heatmap,
    rank_lists,
    top_features,
    unpivot_lists,
)

KEYS = ["timestamp"]


def test_outer_merge_coalesces_observed(spark):
    a = spark.createDataFrame([(1, 10.0, 1.0), (2, None, 2.0)], "timestamp int, Observed double, Z double")
    b = spark.createDataFrame([(2, 20.0, 5.0), (3, 30.0, 6.0)], "timestamp int, Observed double, A double")
    got = merge_forecasts(a, b)
    assert got.columns == ["timestamp", "Observed", "A", "Z"]
    rows = {r.timestamp: r for r in got.collect()}
    assert [rows[i].Observed for i in (1, 2, 3)] == [10.0, 20.0, 30.0]
    assert (rows[1].A, rows[3].Z) == (None, None)


def test_block_merge_prefers_left_models(spark):
    a = spark.createDataFrame([(1, 10.0, 1.0), (2, None, 2.0)], "timestamp int, Observed double, GBR double")
    b = spark.createDataFrame([(2, 20.0, 9.0, 5.0)], "timestamp int, Observed double, GBR double, TiDE double")
    got = merge_blocks(a, b)
    assert got.columns == ["timestamp", "Observed", "GBR", "TiDE"]
    assert got.collect() == [(2, 20.0, 2.0, 5.0)]


def test_side_by_side_pads(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, a string")
    b = spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "pos int, b string")
    got = side_by_side([a, b]).orderBy("pos").collect()
    assert [(r.a, r.b) for r in got] == [("x", "p"), ("y", "q"), (None, "r")]


def test_union_of_rankings(spark):
    a = spark.createDataFrame([("m", "24", "2,5")], "model string, HorizonHours string, MAE string")
    b = spark.createDataFrame([("k", "24", "1.5", "9"), ("k", "8", "x", "9")],
                              "model string, HorizonHours string, MAE string, R2 string")
    got = sort_rankings(union_rankings([a, b])).collect()
    assert [(r.model, r.HorizonHours, r.MAE, r.R2) for r in got] == [("k", 8, None, "9"), ("k", 24, 1.5, "9"), ("m", 24, 2.5, None)]
    assert coerce_columns(a, ["none"]).columns == a.columns


@pytest.fixture(scope="module")
def lists(spark):
    wide = spark.createDataFrame(
        [(0, " load", "price", 1.0), (1, "price", "load", 3.0), (2, "", "wind", 2.0), (3, "load", None, 0.5), (4, "sun", None, 0.1)],
        "pos int, xgb_feature string, gbr_feature string, xgb_importance double",
    )
    return unpivot_lists(wide)


def test_rank_lists(lists):
    got = rank_lists(lists).toPandas().sort_values(["model", "rank"])
    assert got.feature.tolist() == ["price", "load", "wind", "load", "price", "sun"]
    assert got["rank"].tolist() == [1, 2, 3, 1, 2, 3]
    aliased = rank_lists(lists, aliases={"sun": "load"}).where("model = 'XGB'")
    assert aliased.count() == 2


def test_rank_by_importance(spark):
    df = spark.createDataFrame([("T", 0, "a", 0.1), ("T", 1, "b", 0.9), ("T", 2, "a", 0.5)],
                               "model string, pos int, feature string, importance double")
    got = {r.feature: r["rank"] for r in rank_lists(df, rank_by="importance").collect()}
    assert got == {"b": 1, "a": 2}


def test_weights(spark, lists):
    models = lists.select("model")
    metrics = metric_table(
        spark.createDataFrame([("XGB", "168", "4,0"), ("XGB", "24", "9"), ("SVM", "168", "1")], "model string, HorizonHours string, MAE string")
    )
    assert metrics.count() == 2
    got = {r.model: r.w for r in model_weights(models, metrics).collect()}
    assert got == {"XGB": 1.0, "GBR": 0.5}
    scaled = {r.model: r.w for r in model_weights(models, metrics, renormalise=True).collect()}
    assert scaled == {"XGB": pytest.approx(2 / 3), "GBR": pytest.approx(1 / 3)}
    equal = {r.model: r.w for r in model_weights(models).collect()}
    assert equal == {"XGB": 0.5, "GBR": 0.5}
    zero = spark.createDataFrame([("XGB", 0.0), ("GBR", 2.0)], "model string, MAE double")
    assert {r.model: r.w for r in model_weights(models, zero).collect()} == {"XGB": 0.0, "GBR": 1.0}
    with pytest.raises(KeyError):
        metric_table(models)


def test_fusion_matches_brute_force(lists):
    ranks = rank_lists(lists)
    weights = {"XGB": 1.0, "GBR": 0.5}
    spark = lists.sparkSession
    wdf = spark.createDataFrame(list(weights.items()), "model string, w double")
    got = fuse(ranks, wdf).toPandas().set_index("feature")
    r = ranks.toPandas()
    r["w"] = r.model.map(weights)
    r["points"] = r["rank"].max() + 1 - r["rank"]
    want = pd.DataFrame(
        {
            "borda": r.groupby("feature").points.sum(),
            "wborda": (r.w * r.points).groupby(r.feature).sum(),
            "rrf": (r.w / (60 + r["rank"])).groupby(r.feature).sum(),
            "mean_rank": r.groupby("feature")["rank"].mean(),
            "median_rank": r.groupby("feature")["rank"].median(),
            "models_count": r.groupby("feature").model.nunique(),
        }
    )
    for c in want:
        np.testing.assert_allclose(got[c][want.index], want[c], err_msg=c)
    norm = (want - want.min()) / (want.max() - want.min())
    np.testing.assert_allclose(got.final_score[want.index], (norm.wborda + norm.rrf) / 2)
    top = top_features(fuse(ranks, wdf), 2)
    heat = rank_heatmap(ranks, top, ["XGB", "GBR"]).toPandas().set_index("feature")
    assert heat.loc["load"].tolist() == [1, 2] and len(heat) == 2


def test_constant_scores_are_zero(spark):
    ranks = spark.createDataFrame([("A", "f", 1), ("B", "g", 1)], "model string, feature string, rank int")
    weights = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "model string, w double")
    got = fuse(ranks, weights).select("borda_norm", "final_score").distinct().collect()
    assert got == [(0.0, 0.0)]
    assert top_features(fuse(ranks, weights), 1).first().feature == "f"
    assert fuse(ranks, weights).where(F.col("models_frac") != 0.5).count() == 0
