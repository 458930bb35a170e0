import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.numeric import inverse_signed_log1p, nan_to_null, signed_log1p, to_number
from seriesloom.functions.text import canonical_model, clean_label
from seriesloom.sources.files import glob, resolve_predictions, suffix_of
from seriesloom.sources.readers import (
    coerce_time,
    covered_models,
    parse_timestamps,
    read_features,
    read_importance_lists,
    read_model_table,
    read_predictions,
    read_smart_csv,
    read_table,
    sniff_separator,
)
from seriesloom.sources.writers import iso_time, write_complete, write_forecasts, write_report, write_summary


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def parts(folder, kind="csv"):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob(f"part-*.{kind}")))


def test_read_table_by_suffix(spark, tmp_path):
    path = put(tmp_path / "raw.csv", "datetime,x\n2024-01-01 00:00:00,1.5\nDatetime ,\nnonsense,3\n2024-01-01 02:00:00,\n")
    got = read_table(spark, path).orderBy("datetime").collect()
    assert [r.x for r in got] == [1.5, None] and got[1].datetime.hour == 2
    spark.createDataFrame([("2024-01-01 05:00:00", float("nan"))], "timestamp string, v double").write.parquet(
        str(tmp_path / "t.parquet")
    )
    only = read_table(spark, str(tmp_path / "t.parquet")).first()
    assert only.v is None and only.timestamp.hour == 5
    for bad in (str(tmp_path / "none.csv"), put(tmp_path / "x.txt", "a"), put(tmp_path / "n.csv", "a,b\n1,2\n"),
                put(tmp_path / "broken.parquet", "junk")):
        empty = read_table(spark, bad)
        assert empty.columns == [] and empty.count() == 0


def test_coerce_time_needs_a_time_column(spark):
    with pytest.raises(KeyError):
        coerce_time(spark.range(1))


def test_feature_and_model_tables(spark, tmp_path):
    path = put(
        tmp_path / "f.csv",
        "datetime,y,a,c\n2024-01-01 00:00:00,1,5,1\n2024-01-01 01:00:00,2,,1\n2024-01-01 03:00:00,3,7,1\n",
    )
    got = read_features(spark, path).orderBy("ts").toPandas()
    assert got.y.tolist() == [1, 3] and got.series_id.unique().tolist() == ["series"]
    table = str(tmp_path / "m.parquet")
    spark.read.csv(path, header=True, inferSchema=True).write.parquet(table)
    model = read_model_table(spark, table, "y").orderBy("ts").toPandas()
    assert model.columns.tolist() == ["series_id", "ts", "y", "a"] and model.a.tolist() == [5, 5, 7]


def test_smart_csv(spark, tmp_path):
    text = "﻿A_feature;﻿B_feature ;v\n load ; price;1,5\n\nwind;;2\n1;2;3;4\n5;6\n"
    good, bad = read_smart_csv(spark, put(tmp_path / "s.csv", text), position=True)
    assert good.columns == ["A_feature", "B_feature", "v", "pos"]
    rows = good.orderBy("pos").collect()
    assert [r.A_feature for r in rows] == ["load", "wind"] and rows[0].v == "1,5"
    assert sorted(r.line for r in bad.collect()) == ["1;2;3;4", "5;6"]
    typed, _ = read_smart_csv(spark, put(tmp_path / "t.csv", "m,n\nx,1\ny,2.5\n"), typed=True)
    assert dict(typed.dtypes) == {"m": "string", "n": "double"}
    assert [sniff_separator(h) for h in ("a|b", "a\tb", 'a,"x;y;z",b', "one")] == ["|", "\t", ",", ","]
    with pytest.raises(FileNotFoundError):
        read_smart_csv(spark, str(tmp_path / "no.csv"))


def test_number_and_label_cleaning(spark):
    df = spark.createDataFrame([("1 234,5",), (" 7,25 ",), ("x",), (None,), ("NaN",)], "t string")
    assert [r.n for r in df.select(to_number("t").alias("n")).collect()] == [1234.5, 7.25, None, None, None]
    labels = spark.createDataFrame([(" a ",), ("  ",), ("b",)], "t string")
    assert [r.x for r in labels.select(clean_label("t", {"b": "beta"}).alias("x")).collect()] == ["a", None, "beta"]
    assert [canonical_model(c) for c in ("xgb_feature", "Tide_feature", "Other_feature")] == ["XGB", "TiDE", "Other"]
    x = spark.createDataFrame([(-5.0,), (0.0,), (7.0,)], "x double")
    back = x.select("x", inverse_signed_log1p(signed_log1p("x")).alias("y")).toPandas()
    np.testing.assert_allclose(back.x, back.y)
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "v double")).first().v is None


def test_predictions_files(spark, tmp_path):
    text = "timestamp,Observed,A,B\n2024-01-01 01:00:00,2,x,1\n2024-01-01 00:00:00,1,3,\nbad,1,1,1\n2024-01-01 02:00:00,,1,1\n"
    path = put(tmp_path / "fc_DP.csv", text)
    put(tmp_path / "fc_other.csv", "x\n")
    assert resolve_predictions(spark, str(tmp_path), "fc").endswith("fc_DP.csv")
    assert resolve_predictions(spark, str(tmp_path), "fc_o").endswith("fc_other.csv")
    with pytest.raises(FileNotFoundError):
        resolve_predictions(spark, str(tmp_path), "zz")
    assert len(glob(spark, f"{tmp_path}/fc*")) == 2 and suffix_of("/a.b/c.CSV") == ".csv"
    got = read_predictions(spark, path).orderBy("timestamp").toPandas()
    assert got.Observed.tolist() == [1, 2] and got.A.tolist()[0] == 3 and np.isnan(got.A.tolist()[1])
    assert covered_models(read_predictions(spark, path), least=0.6) == []
    assert covered_models(read_predictions(spark, path)) == ["A", "B"]
    with pytest.raises(ValueError):
        read_predictions(spark, put(tmp_path / "q.csv", "a,b\n1,2\n"))
    odd = spark.createDataFrame([("2024-01-01",), ("no",)], "timestamp string")
    assert parse_timestamps(odd).count() == 1 and parse_timestamps(odd, "other") is odd


def test_importance_lists(spark, tmp_path):
    path = put(tmp_path / "i.csv", "xgb_feature,xgb_importance,gbr_feature,gbr_importance\na,3,b,1\nb,2,,\n")
    got = read_importance_lists(spark, path).orderBy("model", "pos").collect()
    assert [(r.model, r.feature) for r in got] == [("GBR", "b"), ("XGB", "a"), ("XGB", "b")]
    with pytest.raises(ValueError):
        read_importance_lists(spark, put(tmp_path / "j.csv", "xgb_feature\na\n"))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame(
        pd.DataFrame({"series_id": ["a", "a"], "ts": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 00:00"]), "y": [1.0, np.nan]}),
        "series_id string, ts timestamp_ntz, y double",
    )
    df = nan_to_null(df)
    assert write_complete(df, str(tmp_path / "p")) == 1
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    write_forecasts(df, str(tmp_path / "f"))
    lines = parts(tmp_path / "f").splitlines()
    assert "timestamp,series_id,y" in lines and "2024-01-01 01:00:00,a,1.000000" in lines
    assert any(line.startswith("2024-01-01 00:00:00,a,") and "1.0" not in line for line in lines)
    write_report(df.select("series_id", "y"), str(tmp_path / "r"), bom=True)
    assert parts(tmp_path / "r").startswith("﻿series_id,y")
    write_summary(spark.sql("SELECT 24 AS horizon, named_struct('MAE', array(1.0D, 2.0D)) AS folds"), str(tmp_path / "j"))
    assert json.loads(parts(tmp_path / "j", "json"))["folds"]["MAE"] == [1.0, 2.0]
    assert df.select(iso_time("ts").alias("t")).first().t == "2024-01-01T01:00:00"
    assert df.where(F.col("y").isNull()).count() == 1


def test_line_numbers_run_over_splits_and_part_files(spark, tmp_path):
    folder = tmp_path / "lists"
    folder.mkdir()
    for part in range(2):
        lines = [f"f{part}_{i},{i}" for i in range(3000)]
        lines[7] = "a,b,c"
        put(folder / f"part-{part}.csv", "name,n\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        good, bad = read_smart_csv(spark, str(folder), position=True)
        rows = good.orderBy("pos").collect()
        assert good.rdd.getNumPartitions() > 4 and good.count() == 5998 and bad.count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(p * 3000 + i, f"f{p}_{i}") for p in range(2) for i in range(3000) if i != 7]
    assert [(r.pos, r.name) for r in rows] == want


def test_a_taken_report_gets_a_second_name(spark, tmp_path):
    target = str(tmp_path / "report")
    old, new = (spark.createDataFrame([(i,) for i in rows], "x int") for rows in ((1, 2), (3, 4, 5)))
    assert write_report(old, target) == target
    second = write_report(new.orderBy("x"), target)
    assert second.startswith(f"{target}_2") and write_report(old, target) not in (target, second)
    assert sorted(r.x for r in spark.read.csv(target, header=True).collect()) == ["1", "2"]
    assert sorted(r.x for r in spark.read.csv(second, header=True).collect()) == ["3", "4", "5"]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
