import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.features import Roles
from seriesloom.operators.forecasters import GradientBoosting, WindowRegression
from seriesloom.operators.imputation import ForestSettings, impute_forest
from seriesloom.plans.jobs import (
    ConsolidationInputs,
    FeatureJob,
    backtest_job,
    consolidate_job,
    evaluate_wide,
    evaluation_job,
    feature_job,
    kfold_job,
    ranking_job,
)
from seriesloom.session import materialise, shared_dir

from .data import panel, spark_panel

SMALL = ForestSettings(num_trees=2, max_depth=2, target_depth=2, max_iter=1)


def read_csv(spark, path):
    return spark.read.csv(str(path), header=True, inferSchema=True)


class OnCluster:
    """Stands for a session whose master is not local."""

    class conf:
        folder = ""

        @classmethod
        def get(cls, key, default=None):
            return cls.folder or default

    class sparkContext:
        master = "spark://head"


def test_intermediate_tables_go_to_the_shared_folder(spark):
    assert materialise(spark.range(5)).count() == 5
    assert shared_dir(spark) == shared_dir(spark)
    with pytest.raises(RuntimeError):
        shared_dir(OnCluster)
    OnCluster.conf.folder = "hdfs://shared/check/"
    assert shared_dir(OnCluster) == "hdfs://shared/check"


def test_imputation_fills_and_keeps_known_values(spark):
    pdf = panel(series=1, gap=0)
    pdf["load2"] = pdf.load * 2 + 1
    holes = pdf.index % 9 == 0
    known = pdf.copy()
    pdf.loc[holes, "load2"] = np.nan
    pdf.loc[pdf.index % 13 == 0, "price"] = np.nan
    df = spark_panel(spark, pdf)
    got = impute_forest(df, "price", settings=ForestSettings(num_trees=15, max_depth=8, max_iter=3)).toPandas()
    got = got.sort_values("ts").reset_index(drop=True)
    assert not got.isna().any().any() and list(got.columns) == list(pdf.columns)
    np.testing.assert_allclose(got.load2[~holes], known.load2[~holes])
    # The filled column follows its source much closer than its median would.
    error = (got.load2 - known.load2)[holes].abs().mean()
    assert error < 0.5 * (known.load2.median() - known.load2)[holes].abs().mean()


def test_imputation_of_a_complete_table_is_the_identity(spark):
    df = spark_panel(spark, panel(series=1, hours=50, gap=0))
    assert impute_forest(df, "price", settings=SMALL).count() == df.count()


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    pdf = panel(hours=200)
    pdf["copy_load"] = pdf.load * 3
    pdf["constant"] = 1.0
    pdf.loc[pdf.index % 17 == 0, "wind"] = np.nan
    df = spark_panel(spark, pdf)
    doubled = df.unionByName(df.where("hour(ts) = 3").withColumn("price", F.col("price") + 1))
    path = str(tmp_path_factory.mktemp("features") / "table")
    # Without these roles three families stay out, which keeps the second imputation small.
    roles = Roles(wind="none", up_reserve="none", wind_generation="none")
    dropped = feature_job(doubled, path, FeatureJob(roles=roles, forest=SMALL))
    table = spark.read.parquet(path)
    assert table.count() + dropped == df.count()
    return table


def test_feature_job(features):
    assert "constant" not in features.columns
    assert len({"load", "copy_load"} & set(features.columns)) == 1
    assert {"price_roll24_mean", "season_winter", "skew_24h"} <= set(features.columns)


def test_backtest_and_kfold_jobs(spark, features, tmp_path):
    some = features.select("series_id", "ts", "price", "hour", "d_price_1h", "std_24h")
    models = {"GBR": GradientBoosting(max_rounds=2, learning_rate=0.3)}
    ranking = backtest_job(
        some, "price", str(tmp_path), models=models, horizons=[12], splits=2, block=12, blocks=2, importance_repeats=1
    )
    got = ranking.toPandas()
    assert set(got.model) == {"GBR", "SARIMA", "SARIMAX"} and set(got.HorizonHours) == {12, 24}
    table = read_csv(spark, tmp_path / "forecasts_h12_hours")
    assert table.columns == ["timestamp", "series_id", "GBR", "SARIMA", "SARIMAX", "Observed"] and table.count() == 24
    assert read_csv(spark, tmp_path / "feature_importance_gbr").count() == 3
    assert read_csv(spark, tmp_path / "feature_importance_sarimax").columns == ["feature", "importance"]
    summary = kfold_job(some, "price", str(tmp_path / "k"), WindowRegression(lookback=3), "WIN", horizons=[12], splits=2)
    assert all(len(r.folds.MAE) == 2 for r in summary.collect())
    assert spark.read.json(str(tmp_path / "k" / "kfold_summary")).count() == 2
    assert (tmp_path / "k" / "kfold" / "horizon=12" / "fold=1").exists()


def test_consolidate_rank_and_evaluate(spark, tmp_path):
    rng = np.random.default_rng(4)
    hours = [f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00" for i in range(60)]
    y = rng.normal(50, 10, 60)
    for name, models in (("a.csv", ("XGB", "GBR")), ("b.csv", ("TiDE",))):
        rows = [f"timestamp;Observed;{';'.join(models)}"]
        rows += [";".join([t, f"{v:.3f}".replace(".", ","), *[f"{v + rng.normal():.3f}" for _ in models]]) for t, v in zip(hours, y)]
        (tmp_path / name).write_text("\n".join(rows))
    (tmp_path / "i1.csv").write_text("xgb_feature,xgb_importance\nload,3\nwind,2\nsun,1\n")
    (tmp_path / "i2.csv").write_text("gbr_feature,gbr_importance\nwind,3\nload,2\n")
    (tmp_path / "r1.csv").write_text("model,HorizonHours,MAE\nXGB,168,2\n")
    (tmp_path / "r2.csv").write_text("model,HorizonHours,MAE\nGBR,168,4\nGBR,168,47,004\n")
    inputs = ConsolidationInputs(
        forecasts={"24h": ("a.csv", "b.csv"), "744h": ("none.csv", "b.csv")},
        blocks={"blocks": ("a.csv", "b.csv")},
        importance={"i1.csv": ("xgb",), "i2.csv": ("gbr",), "i3.csv": ("svm",)},
        rankings=("r1.csv", "r2.csv"),
    )
    out = str(tmp_path / "out")
    assert consolidate_job(spark, str(tmp_path), inputs, out) == ["forecasts_24h", "feature_importance", "blocks", "ranking_models"]
    merged = read_csv(spark, f"{out}/forecasts_24h")
    assert merged.columns == ["timestamp", "Observed", "GBR", "TiDE", "XGB"] and merged.count() == 60
    assert read_csv(spark, f"{out}/ranking_models").count() == 2
    # The malformed line of the second ranking file is kept next to the outputs.
    assert [r.value for r in spark.read.text(f"{out}/rejected/r2.csv").collect()] == ["GBR,168,47,004"]
    fused = ranking_job(spark, f"{out}/feature_importance".replace("feature_importance", "feature_importance/"), f"{out}/ranking_models", f"{out}/rank")
    scores = {r.feature: r.final_score for r in fused.collect()}
    assert max(scores, key=scores.get) == "load" and scores["sun"] == 0.0
    merged.coalesce(1).write.parquet(str(tmp_path / "blocks_x.parquet"))
    tables = evaluation_job(spark, str(tmp_path), "blocks_x", f"{out}/eval")
    assert tables["dm_raw"].count() == 6 and tables["peak_metrics"].count() == 9
    assert read_csv(spark, f"{out}/eval/dm_summary_blocks_x").count() == 6
    assert evaluate_wide(merged, ["XGB", "GBR"], fixed=60.0)["peak_metrics"].where("threshold = 60").count() == 6
