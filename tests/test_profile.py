import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.operators.profile import (
    columns_to_drop,
    constant_columns,
    correlated_pairs,
    drop_constant,
    drop_correlated,
    mean_correlation,
    absolute_correlations,
    missing_report,
    numeric_summary,
)
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.operators.scaling import moments, scale_signed_log, standardise


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    pdf = pd.DataFrame(
        {"a": a, "b": a + rng.normal(0, 0.05, 400), "c": rng.normal(size=400), "d": 2 * a, "k": 1.0, "z": np.nan}
    )
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    return pdf, df.replace(float("nan"), None)


def test_missing_and_summary(wide):
    pdf, df = wide
    got = missing_report(df).toPandas().set_index("column_name")
    assert got.missing["b"] == pdf.b.isna().sum() and got.missing_pct["z"] == 100.0
    want = pdf.describe().T
    summary = numeric_summary(df, ["a", "b", "c"]).toPandas().set_index("column_name")
    for name, other in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("max", "max")):
        np.testing.assert_allclose(summary[name][["a", "b", "c"]], want[other][["a", "b", "c"]])


def test_constant_columns_are_dropped(wide):
    _, df = wide
    flags = {r.column_name: r.constant for r in constant_columns(df).collect()}
    assert flags == {"a": False, "b": False, "c": False, "d": False, "k": True, "z": True}
    kept, removed = drop_constant(df)
    assert removed == ["k", "z"] and kept.columns == ["a", "b", "c", "d"]


def test_correlations_match_pandas(wide):
    pdf, df = wide
    names = ["a", "b", "c", "d"]
    want = pdf[names].corr().abs()
    rows = absolute_correlations(df, names)
    for r in rows.collect():
        assert r["corr"] == pytest.approx(want.loc[r.feature_1, r.feature_2])
    got = {r.column_name: r.mean_abs_corr for r in mean_correlation(rows).collect()}
    for c in names:
        assert got[c] == pytest.approx(want[c].mean())
    assert {(r.feature_1, r.feature_2) for r in correlated_pairs(df, 0.95, names).collect()} == {
        ("a", "b"), ("a", "d"), ("b", "d"),
    }


def test_pruning_rule(spark, wide):
    _, df = wide
    kept, dropped = drop_correlated(df.select("a", "b", "c", "d"), protected=["a"])
    assert "a" in kept.columns and "c" in kept.columns and len(dropped) >= 1
    # The pair rule keeps the first price column and stops there.
    corr = {("fixing_i_price", "fixing_ii_price"): 0.99, ("fixing_i_price", "x"): 0.1, ("fixing_ii_price", "x"): 0.2}
    names = ["fixing_i_price", "fixing_ii_price", "x"]
    def condemned(corr, names, **options):
        rows = [(a, b, v) for (a, b), v in corr.items()]
        return columns_to_drop(spark.createDataFrame(rows, "feature_1 string, feature_2 string, corr double"), names, **options)

    assert condemned(corr, names) == ["fixing_ii_price"]
    assert condemned(corr, names, protected=["fixing_ii_price"]) == []
    # Ties go to the judged column, which is listed first in its group.
    assert condemned({("p", "q"): 1.0}, ["p", "q"]) == ["q"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.sampled_from([2, 5, 2000]))
def test_exact_quantiles_equal_pandas(spark, values, accuracy):
    qs = [0.0, 0.11, 0.5, 0.95, 1.0]
    df = spark.createDataFrame([("k", float(v)) for v in values], "key string, v double")
    got = exact_quantiles(df, keys=["key"], value="v", qs=qs, bins=max(accuracy, 2), few_values=accuracy).collect()
    for r in got:
        assert r["quantile"] == pytest.approx(pd.Series(values).quantile(r.q))


def test_exact_quantiles_narrow_large_groups(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") < 40_000, "hot").otherwise("cold").alias("key"),
        F.pow(F.pmod(F.xxhash64("id"), F.lit(9_973)) / 100.0, F.lit(3.0)).alias("v"),
    )
    pdf = df.toPandas()
    for r in exact_quantiles(df, keys=["key"], value="v", qs=[0.003, 0.5, 0.92], bins=50, few_values=500).collect():
        assert r["quantile"] == pytest.approx(pdf[pdf.key == r.key].v.quantile(r.q))


def test_scaling_uses_population_moments_of_training_rows(spark):
    rows = [(1.0, True), (2.0, True), (4.0, True), (-9.0, False)]
    df = spark.createDataFrame(rows, "x double, train boolean")
    fitted = moments(df, ["x"], train=F.col("train"))
    z = [r.x for r in standardise(df, ["x"], fitted).collect()]
    base = np.array([1.0, 2.0, 4.0])
    np.testing.assert_allclose(z, (np.array([1, 2, 4, -9]) - base.mean()) / base.std())
    out = scale_signed_log(df, "x", train=F.col("train")).toPandas()
    np.testing.assert_allclose(out.restored, out.x)
