"""Permutations of places, exact selection, running sums and correlations in few scans."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.permute import round_keys, shuffled_place, shuffled_place_sql
from seriesloom.operators.chunks import running_sums
from seriesloom.operators.importance import with_donors
from seriesloom.operators.profile import absolute_correlations, numeric_summary
from seriesloom.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("size", [1, 2, 3, 7, 24, 168, 5000])
def test_shuffled_places_are_a_permutation_in_both_engines(spark, size):
    keys = round_keys(42, 3)
    rows = spark.range(size).select("id", shuffled_place(F.col("id"), F.lit(size), keys).alias("to")).toPandas()
    assert sorted(rows.to) == list(range(size))
    sql = shuffled_place_sql("i", str(size), keys)
    same = duckdb.sql(f"SELECT i AS id, {sql} AS to_ FROM range({size}) r(i) ORDER BY i").df()
    assert same.to_.tolist() == rows.sort_values("id").to.tolist()


def test_shuffles_look_random(spark):
    """Places move evenly: every target tenth gets its share of every source tenth, in each repeat."""
    n = 2000
    places = [shuffled_place(F.col("id"), F.lit(n), round_keys(7, r)).alias(f"r{r}") for r in range(1, 6)]
    rows = spark.range(n).select("id", *places).toPandas()
    for r in range(1, 6):
        table = pd.crosstab(rows.id // 200, rows[f"r{r}"] // 200).to_numpy()
        assert 60 < ((table - 20) ** 2 / 20).sum() < 120  # 81 expected, 95 % between 58 and 108
        assert abs(np.corrcoef(rows.id, rows[f"r{r}"])[0, 1]) < 0.1
    assert abs(np.corrcoef(rows.r1, rows.r2)[0, 1]) < 0.1


def test_donors_move_whole_rows_once_per_repeat(spark):
    rows = spark.range(60).select(
        (F.col("id") % 2).alias("series_id"), F.floor(F.col("id") / 2).alias("place"), F.lit(30).alias("size"),
        F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"),
    )
    got = with_donors(rows, ["a", "b"], repeats=4).collect()
    assert len(got) == 60 and all(sorted(d.repeat for d in r["__donors"]) == [1, 2, 3, 4] for r in got)
    for series in (0, 1):
        mine = [r for r in got if r.series_id == series]
        for repeat in range(1, 5):
            moved = [(r.a, d["values"]) for r in mine for d in r["__donors"] if d.repeat == repeat]
            assert sorted(v[0] for _, v in moved) == sorted(a for a, _ in moved)
            assert all(v[1] == -v[0] for _, v in moved) and any(v[0] != a for a, v in moved)


@pytest.mark.parametrize("few_keys", [True, False])
@pytest.mark.parametrize(("bins", "few_values"), [(2, 1), (7, 20), (1024, 1 << 16)])
def test_quantiles_of_hot_and_odd_groups(spark, few_keys, bins, few_values):
    rng = np.random.default_rng(6)
    groups = {
        "hot": rng.lognormal(0, 4, 3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([5.0]),
        "two": np.array([-1.0, 4.0]), "equal": np.full(40, 0.1), "far": np.array([1e308, -1e308, 0.0, 1.0, 2.0]),
        "close": 1.0 + np.arange(50) * 2.0**-52, "tiny": np.arange(9) * 5e-324,
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", float("nan")), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    qs = (0.0, 0.05, 0.5, 0.77, 1.0)
    got = exact_quantiles(df, keys=["k"], value="v", qs=qs, few_keys=few_keys, bins=bins, few_values=few_values).collect()
    assert len(got) == len(groups) * len(qs)
    for r in got:
        ordered = np.sort(groups[r.k])
        rank = (len(ordered) - 1) * r.q
        a, b = ordered[int(np.floor(rank))], ordered[int(np.ceil(rank))]
        assert r.n == len(ordered) and r["quantile"] == a + (b - a) * (rank - np.floor(rank))


def test_infinite_values_and_empty_tables_have_quantiles(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("a", float("-inf"))], "k string, v double")
    got = exact_quantiles(df, keys=["k"], value="v", qs=[0, 0.5, 1], bins=2, few_values=1).orderBy("q").collect()
    assert [r["quantile"] for r in got] == [-1.7976931348623157e308, 1.0, 1.7976931348623157e308]
    assert exact_quantiles(df.limit(0), keys=["k"], value="v", qs=[0.5]).count() == 0
    assert [r.p50 for r in numeric_summary(df.limit(0).select("v")).collect()] == [None]


@pytest.mark.parametrize("chunk_rows", [7, 4096])
def test_running_sums(spark, chunk_rows):
    pdf = pd.DataFrame({"series_id": "a", "pos": np.arange(50), "x": np.arange(50.0), "z": 1.0})
    pdf.loc[5, "z"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    got = running_sums(df, ["x", "z"], chunk_rows=chunk_rows).toPandas().sort_values("pos")
    np.testing.assert_array_equal(got.x, np.cumsum(np.arange(50.0)))
    np.testing.assert_array_equal(got.z, np.cumsum(pdf.z.fillna(0)))


def test_correlations_of_many_columns_take_one_pass(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 1))
    values = base * rng.normal(size=(1, 40)) + rng.normal(size=(300, 40)) + 1e7 * rng.normal(size=(1, 40))
    values[rng.random(values.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(values, columns=[f"v{i}" for i in range(40)]).assign(flat=0.1, lost=np.nan)
    df = spark.createDataFrame(pdf).repartition(3)
    read = spark.sparkContext.accumulator(0)

    def watched(parts):
        for part in parts:
            read.add(len(part))
            yield part

    found = absolute_correlations(df.mapInPandas(watched, df.schema))
    found.collect()
    assert read.value == 300  # every row once
    want = (pdf - pdf.mean()).corr().abs()  # centred first: the level of 1e7 costs pandas digits
    got = {(r.feature_1, r.feature_2): r["corr"] for r in found.collect()}
    assert len(got) == 42 * 41 // 2
    for (a, b), c in got.items():
        assert c is None if {a, b} & {"flat", "lost"} else c == pytest.approx(want.loc[a, b], abs=1e-9)
    assert absolute_correlations(df.limit(0)).where("corr IS NOT NULL").count() == 0
    assert absolute_correlations(df.select("v1")).count() == 0
