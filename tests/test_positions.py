import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.operators.chunks import forward_fill, over_chunks
from seriesloom.operators.grid import (
    duplicate_report,
    head_and_tail,
    keep_first,
    last_hours,
    last_rows,
    regularise,
)
from seriesloom.operators.positions import attach_by_series, with_positions

from .data import START, collected, panel, spark_panel


@pytest.mark.parametrize("bucket_rows", [7, 50, 4096])
def test_positions_equal_row_number(spark, bucket_rows):
    df = spark_panel(spark, panel())
    got = with_positions(df, bucket_rows=bucket_rows, sums={"total": F.col("price")})
    w = Window.partitionBy("series_id")
    want = df.withColumns(
        {
            "pos2": F.row_number().over(w.orderBy("ts")) - 1,
            "n2": F.count(F.lit(1)).over(w),
            "total2": F.sum("price").over(w),
        }
    )
    both = got.join(want.select("series_id", "ts", "pos2", "n2", "total2"), ["series_id", "ts"]).toPandas()
    assert len(both) == df.count()
    assert (both.pos == both.pos2).all() and (both.n == both.n2).all()
    assert np.allclose(both.total, both.total2)


@pytest.mark.parametrize("chunk_rows", [30, 64, 4096])
def test_chunked_windows_equal_whole_windows(spark, chunk_rows):
    df = with_positions(spark_panel(spark, panel()), bucket_rows=40)

    def build(w):
        return {
            "before": F.sum("price").over(w.rowsBetween(-24, -1)),
            "around": F.max("price").over(w.rowsBetween(-5, 9)),
            "lagged": F.lag("price", 25).over(w),
        }

    got = over_chunks(df, build, before=25, after=9, chunk_rows=chunk_rows)
    want = df.withColumns(build(Window.partitionBy("series_id").orderBy("pos")))
    a, b = collected(got, "series_id", "pos"), collected(want, "series_id", "pos")
    pd.testing.assert_frame_equal(a, b[a.columns])


@pytest.mark.parametrize("chunk_rows", [5, 33])
def test_forward_fill_across_chunks(spark, chunk_rows):
    pdf = panel(gap=0)
    pdf.loc[pdf.index % 40 > 3, "price"] = np.nan
    pdf.loc[:10, "price"] = np.nan
    df = spark_panel(spark, pdf).withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    got = collected(forward_fill(with_positions(df), ["price"], chunk_rows=chunk_rows), "series_id", "ts")
    want = pdf.sort_values(["series_id", "ts"]).groupby("series_id").price.ffill().reset_index(drop=True)
    pd.testing.assert_series_equal(got.price, want, check_names=False)


def test_regularise_fills_every_hour(spark):
    pdf = panel()
    got = collected(regularise(spark_panel(spark, pdf), bucket_rows=17), "series_id", "ts")
    want = pd.concat(
        [g.set_index("ts").price.asfreq("h").reset_index().assign(series_id=s) for s, g in pdf.groupby("series_id")]
    ).reset_index(drop=True)
    assert (got.ts == want.ts).all() and (got.series_id == want.series_id).all()
    assert np.allclose(got.price, want.price, equal_nan=True)


def test_keep_first_and_duplicates(spark):
    rows = [("a", 1, 2, 5.0), ("a", 1, 1, 7.0), ("a", 2, 3, None), ("b", 1, 9, 1.0)]
    df = spark.createDataFrame(rows, "k string, hour int, seq int, v double")
    got = collected(keep_first(df, keys=["k", "hour"], order=["seq"]), "k", "hour")
    assert got.seq.tolist() == [1, 3, 9]
    report = duplicate_report(df, keys=["k", "hour"]).first()
    assert (report.duplicate_rows, report.duplicate_keys, report.first_keys) == (1, 1, "a 1")


def test_slices_and_attach(spark):
    pdf = panel(gap=0)
    df = with_positions(spark_panel(spark, pdf))
    got = last_hours(df, 10).groupBy("series_id").count().toPandas()
    assert (got["count"] == 10).all()
    assert (last_rows(df, 7).groupBy("series_id").count().toPandas()["count"] == 7).all()
    parts = head_and_tail(df, 2).groupBy("series_id", "part").count().toPandas()
    assert (parts["count"] == 2).all() and len(parts) == 4
    table = spark.createDataFrame([("s0", 1.5), ("s1", 2.5)], "series_id string, extra double")
    joined = attach_by_series(df, table, bucket_rows=16)
    assert joined.count() == df.count()
    assert joined.where("extra = 1.5").select("series_id").distinct().first()[0] == "s0"
    assert START == pdf.ts.min()
