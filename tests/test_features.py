import math
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.functions.calendar import calendar_columns, season_columns, season_name
from seriesloom.operators.features import Roles, add_families, feature_table
from seriesloom.operators.positions import with_positions

from .data import collected, panel, spark_panel


def brute(rows: list[dict]) -> list[dict]:
    """The features of one series straight from their definitions, row by row.

    Everything looks at earlier rows only: ``back`` is the row before, ``last`` the
    up to 24 rows before. None stands for what is not defined.
    """

    def spread(v, least=2):
        return statistics.stdev(v) if len(v) >= least else None

    def shape(v):
        n, mean = len(v), sum(v) / len(v) if v else 0
        m2, m3, m4 = (sum((x - mean) ** k for x in v) / n if n else 0 for k in (2, 3, 4))
        if n < 6 or m2 == 0:
            return None, None
        skew = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
        return skew, ((n + 1) * (m4 / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))

    out = []
    for i in range(len(rows)):
        last = [r["price"] for r in rows[max(0, i - 24) : i]]
        back = rows[i - 1] if i else None
        loads = [r["load"] for r in rows[max(0, i - 24) : i]]
        middle = statistics.median(loads) if len(loads) >= 6 else None
        # The deviations of a window are taken from the median of that same window.
        deviation = statistics.median([abs(x - middle) for x in loads]) if middle is not None else None
        skew, kurt = shape(last)
        base = back["load"] + 1e-9 if back else None
        out.append(
            {
                "price_roll24_mean": sum(last) / len(last) if last else None,
                "price_roll24_std": spread(last),
                "price_roll24_min": min(last) if last else None,
                "d_price_1h": abs(rows[i - 1]["price"] - rows[i - 2]["price"]) if i >= 2 else 0.0,
                "d_price_24h": abs(rows[i - 1]["price"] - rows[i - 25]["price"]) if i >= 25 else 0.0,
                "std_6h": spread(last[-6:]) or 0.0,
                "skew_24h": skew,
                "kurt_24h": kurt,
                "price_over_load": back["price"] / base if back else None,
                "price_minus_norm_load": back["price"] - (back["load"] - middle) / (deviation + 1e-9) if middle is not None else None,
                "imbalance_ratio": (back["up_reserve"] - back["down_reserve"]) / base if back else None,
                "renew_share": (back["wind"] + back["solar"]) / (back["total_gen"] + 1e-9) if back else None,
            }
        )
    return out


def test_families_match_their_definitions_for_any_chunk_size(spark):
    pdf = panel().sort_values(["series_id", "ts"]).reset_index(drop=True)
    want = pd.DataFrame([f for _, g in pdf.groupby("series_id") for f in brute(g.to_dict("records"))]).astype(float)
    for chunk in (40, 4096):
        df = with_positions(spark_panel(spark, pdf), bucket_rows=chunk)
        got = collected(add_families(df, chunk_rows=chunk), "series_id", "ts")
        for c in want.columns:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_absent_roles_skip_their_family(spark):
    df = with_positions(spark_panel(spark, panel())).drop("wind")
    out = add_families(df)
    assert "wind_share" not in out.columns and "renew_share" not in out.columns
    assert "price_roll24_mean" in out.columns
    assert add_families(df.select("series_id", "ts", "pos", "n")).columns == ["series_id", "ts", "pos", "n"]


def test_zero_load_and_flat_window_give_null(spark):
    pdf = panel(series=1, gap=0)
    pdf.loc[30, "load"] = 0.0
    pdf.loc[100:140, "price"] = 7.0
    got = collected(add_families(with_positions(spark_panel(spark, pdf))), "series_id", "ts")
    assert np.isnan(got.price_over_load[31]) and np.isnan(got.wind_share[31])
    assert np.isnan(got.skew_24h[130]) and np.isnan(got.kurt_24h[130])


def test_feature_table_has_calendar_and_no_nulls(spark):
    out = feature_table(spark_panel(spark, panel()), roles=Roles())
    got = out.toPandas()
    assert len(got) and not got.isna().any().any()
    assert {"hour", "sin168", "season_winter", "renew_share"} <= set(got.columns)


def test_calendar(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 23:30:00' AS ts UNION ALL SELECT TIMESTAMP_NTZ '2023-12-04 00:00:00'")
    named = df.withColumns(calendar_columns("ts") | season_columns("ts")).withColumn("season", season_name("ts"))
    rows = {r.month: r for r in named.collect()}
    assert (rows[3].hour, rows[3].day_of_week, rows[3].weekend, rows[3].season) == (23, 6, 1, "spring")
    assert (rows[12].day_of_week, rows[12].quarter, rows[12].season_winter) == (0, 4, 1)
    assert season_columns(F.col("ts"), dummies=False).keys() == {"quarter", "season"}
