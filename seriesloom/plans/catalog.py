"""Registered queries: each takes a session and the folder of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, season_columns, season_name
from ..functions.numeric import to_number
from ..functions.text import BOM
from ..functions.time import DAY, truncate
from ..operators.arma import SARIMAX_ORDER, SARIMAX_SEASONAL, SeasonalArma
from ..operators.autoregression import seasonal_autoregression
from ..operators.backtest import block_backtest, failures, walk_forward
from ..operators.baselines import baseline_predictions
from ..operators.chunks import forward_fill
from ..operators.comparison import diebold_mariano, dm_summary, sorted_summary, wide_predictions
from ..operators.decompose import seasonal_decompose
from ..operators.features import Roles, add_families, feature_table
from ..operators.folds import HORIZONS, N_SPLITS, block_rows, fold_bounds, fold_table, holdout, lookback_windows
from ..operators.forecasters import (
    CrossValidatedBoosting,
    GradientBoosting,
    LeastSquares,
    RandomSearch,
    WindowRegression,
    exogenous_columns,
)
from ..operators.grid import duplicate_report, head_and_tail, keep_first, last_hours, last_rows, regularise
from ..operators.importance import permutation_importance, top_importance, window_importance
from ..operators.imputation import ForestSettings, impute_forest
from ..operators.merge import merge_blocks, merge_forecasts, side_by_side, sort_rankings, union_rankings
from ..operators.metrics import (
    accuracy,
    common_timestamps,
    fold_mean,
    fold_summary,
    model_coverage,
    pooled_ranking,
    prediction_health,
    walk_forward_ranking,
)
from ..operators.peaks import best_peak_models, month_view, peak_metrics, peak_thresholds
from ..operators.positions import rank_sorted, with_positions
from ..operators.profile import (
    constant_columns,
    correlated_pairs,
    drop_correlated,
    missing_report,
    numeric_summary,
)
from ..operators.ranking import (
    fuse,
    metric_table,
    model_weights,
    rank_heatmap,
    rank_lists,
    top_features,
)
from ..operators.scaling import scale_signed_log
from ..operators.stationarity import adf, kpss
from ..session import materialise, shared_dir
from ..sources.files import resolve_predictions
from ..sources.readers import (
    coerce_time,
    parse_time,
    read_features,
    read_importance_lists,
    read_model_table,
    read_predictions,
    read_smart_csv,
    read_table,
)
from ..sources.writers import iso_time, write_complete, write_forecasts, write_summary
from .inputs import (
    BASELINES,
    events_panel,
    events_positions,
    events_predictions,
    orders_panel,
    orders_positions,
    table,
    tidy,
    user_lists,
)
from .jobs import ConsolidationInputs, FeatureJob, build_features, consolidate_job

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


# ---- sources, grid, duplicates -------------------------------------------------


@register
def hourly_grid_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = events_panel(spark, sf_dir).select("series_id", "ts", "price", "load")
    grid = with_positions(materialise(regularise(panel)))
    filled = forward_fill(grid.withColumn("price_ffill", F.col("price")), ["price_ffill"])
    return tidy(filled.select("series_id", "ts", "price", "load", "price_ffill", "pos"))


@register
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"),
        truncate("ts").alias("hour"),
        "ts", "event_id", "user_id", "value",
    )
    return keep_first(rows, keys=["series_id", "hour"], order=["ts", "event_id"])


@register
def duplicate_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", truncate("ts").alias("hour"))
    report = duplicate_report(rows, keys=["event_type", "hour"])
    return report.select("duplicate_rows", "duplicate_keys", "duplicate_columns")


@register
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("event_id") % 50 == 0, F.lit(" Timestamp "))
        .when(F.col("event_id") % 37 == 0, F.lit("not a time"))
        .otherwise(F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    )
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("timestamp"))
    return coerce_time(rows)[0].select("event_id", F.col("timestamp").alias("ts"))


@register
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.translate(F.col("value").cast("string"), ".", ",")
    text = F.when(F.col("user_id") % 10 == 0, F.lit("n/a")).otherwise(
        F.concat(F.lit(" "), shown, F.lit(" "))
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id", text.alias("text"), F.regexp_extract("props", r"(\d+)", 1).alias("k_text")
    )
    return rows.select(
        "event_id", to_number("text").alias("number"), to_number("k_text").alias("k")
    )


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seriesloom/{uuid.uuid4().hex}/{name}"


@register
def forecast_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts written as CSV, found by their stem and read back."""
    wide = tidy(wide_predictions(events_predictions(spark, sf_dir), BASELINES))
    path = _scratch(spark, "run_DP.csv")
    write_forecasts(wide.withColumnRenamed("y", "Observed"), path)
    found = resolve_predictions(spark, path.rsplit("/", 1)[0], "run")
    # Five of the six decimals: the engines settle ties of the sixth differently.
    return read_predictions(spark, found, keys=["series_id"]).withColumns(
        {c: F.round(c, 5) for c in ("Observed", *BASELINES)}
    )


@register
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet sink that keeps complete rows, read back."""
    path = _scratch(spark, "table")
    write_complete(regularise(events_panel(spark, sf_dir)), path)
    return tidy(spark.read.parquet(path))


@register
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model input on its grid, filled forward, constant columns removed."""
    path = _scratch(spark, "table")
    panel = events_panel(spark, sf_dir).withColumn("unit", F.lit(1.0))
    panel.withColumnRenamed("ts", "timestamp").write.parquet(path)
    return tidy(read_model_table(spark, path, "price", series=["series_id"]))


@register
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists side by side in a file with semicolons and marked headers, read back."""
    path = _scratch(spark, "lists.csv")
    lists_side_by_side(spark, sf_dir).orderBy("pos").drop("pos").withColumnRenamed(
        "click_feature", f"{BOM}click_feature"
    ).write.option("header", True).option("sep", ";").csv(path)
    return rank_lists(read_importance_lists(spark, path))


@register
def loaded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as CSV, with header rows in its middle, and as Parquet, both loaded by suffix."""
    panel = events_panel(spark, sf_dir).select(F.col("ts").alias("datetime"), "series_id", "price", "load")
    text = panel.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    header = text.limit(1).select(F.lit(" DateTime ").alias("datetime"), "series_id", "price", "load")
    paths = {kind: _scratch(spark, f"panel.{kind}") for kind in ("csv", "parquet")}
    text.unionByName(header).write.option("header", True).csv(paths["csv"])
    panel.write.parquet(paths["parquet"])
    parts = [
        read_table(spark, path).select(F.lit(kind).alias("source"), F.col("datetime").alias("ts"), "series_id", "price",
                                       F.col("load").cast("double").alias("load"))
        for kind, path in paths.items()
    ]
    return tidy(parts[0].unionByName(parts[1]))


@register
def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature file put on its hourly grid, complete rows only."""
    path = _scratch(spark, "features.parquet")
    events_panel(spark, sf_dir).withColumnRenamed("ts", "datetime").write.parquet(path)
    return tidy(read_features(spark, path, series=["series_id"]))


@register
def typed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with semicolons, text cells and gaps, its number columns recognised."""
    path = _scratch(spark, "panel.csv")
    panel = events_panel(spark, sf_dir).select("series_id", "ts", "load", "wind", "solar")
    text = {c: F.concat(F.lit("  "), F.col(c).cast("string"), F.lit(" ")) for c in ("load", "wind", "solar")}
    shown = panel.withColumns(text | {"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})
    shown.write.option("header", True).option("sep", ";").csv(path)
    good, _ = read_smart_csv(spark, path, typed=True)
    return tidy(good.withColumn("ts", parse_time("ts")))


@register
def exogenous_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the columns that an exogenous model uses: numeric, not the target, not listed."""
    panel = events_panel(spark, sf_dir)
    return missing_report(panel.select(exogenous_columns(panel, "price", ["load", "total_gen"])))


@register
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", iso_time("ts").alias("at"))


@register
def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold summaries written as JSON and read back, a row per fold."""
    per_fold = accuracy(events_predictions(spark, sf_dir), ["series_id", "model", "fold"], null_safe=True)
    path = _scratch(spark, "summary")
    summary = fold_summary(per_fold, ["series_id", "model"])
    write_summary(summary, path)
    back = spark.read.schema(summary.schema).json(path)
    return tidy(back.select("series_id", "model", "MAE", F.posexplode("folds.RMSE").alias("fold", "RMSE")))


# ---- features -------------------------------------------------------------------


@register
def calendar_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int))").alias("ts"),
    )
    named = days.withColumns(calendar_columns("ts") | season_columns("ts"))
    return tidy(named.withColumn("season", season_name("ts")))


def _family(spark: SparkSession, sf_dir: str, names: list[str], keep: list[str]) -> DataFrame:
    out = add_families(events_positions(spark, sf_dir), names)
    return tidy(out.select("series_id", "ts", *keep))


@register
def lag_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(
        spark, sf_dir, ["ratios", "imbalance", "renewable"],
        ["wind_share", "solar_share", "import_share", "sys_margin_MW", "imbalance_ratio",
         "price_x_imbalance", "renew_share", "price_x_renew_share"],
    )


@register
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"price_roll24_{s}" for s in ("mean", "std", "min", "max")]
    return _family(spark, sf_dir, ["rolling"], names)


@register
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(
        spark, sf_dir, ["volatility"], ["d_price_1h", "d_price_24h", "std_6h", "std_24h"]
    )


@register
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, ["demand"], ["price_over_load", "price_minus_norm_load"])


@register
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, ["shape"], ["skew_24h", "kurt_24h"])


@register
def hourly_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling and shape features on the full grid, so that frames are true hours."""
    grid = with_positions(materialise(regularise(events_panel(spark, sf_dir))))
    out = add_families(grid, ["rolling", "volatility", "shape"])
    names = [c for c in out.columns if c.startswith("price_roll") or c in (
        "d_price_1h", "d_price_24h", "std_6h", "std_24h", "skew_24h", "kurt_24h")]
    return tidy(out.select("series_id", "ts", *names))


@register
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature table of the hourly panel, complete rows only."""
    return tidy(feature_table(events_panel(spark, sf_dir)))


# ---- profiling and pruning --------------------------------------------------------


@register
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_report(regularise(events_panel(spark, sf_dir)))


@register
def summary_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(numeric_summary(table(spark, sf_dir, "lineitem")))


@register
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_positions(spark, sf_dir).select("series_id", "ts", "price", "pos", "n")
    return tidy(head_and_tail(rows).select("series_id", "part", "ts", "price"))


def _priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        net.alias("net_price"),
        (net * (1 + F.col("l_tax"))).alias("gross_price"),
        F.lit(1.0).alias("unit"),
        F.lit(None).cast("double").alias("nothing"),
    )


@register
def zero_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constant_columns(_priced_lines(spark, sf_dir))


_PRICED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "gross_price"]


@register
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(correlated_pairs(_priced_lines(spark, sf_dir), 0.9, _PRICED))


@register
def corr_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _priced_lines(spark, sf_dir).select(*_PRICED)
    kept, dropped = drop_correlated(lines, threshold=0.9, protected=["l_extendedprice"])
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(c in dropped).alias("dropped")) for c in _PRICED]
    sums = kept.agg(F.count(F.lit(1)).alias("rows"))
    return sums.select("rows", F.explode(F.array(*entries)).alias("e")).select("rows", "e.*")


@register
def signed_log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return tidy(scale_signed_log(rows, "c_acctbal", train=F.col("c_custkey") % 10 != 0))


# ---- folds, baselines, backtests ----------------------------------------------------


@register
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_positions(spark, sf_dir).select("series_id", "ts", "pos", "n")
    return fold_table(rows, [24, 72], 5, context=23).select(
        "series_id", "ts", "horizon", "fold", "role", "is_context"
    )


@register
def fold_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_bounds(orders_positions(spark, sf_dir), [24, 168, 336, 744], 5)


@register
def block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = block_rows(orders_positions(spark, sf_dir), 168, 10)
    return blocks.groupBy("series_id", F.col("fold").alias("block")).agg(
        F.min("pos").alias("train_rows"),
        F.min("ts").alias("block_from"),
        F.max("ts").alias("block_to"),
        F.count(F.lit(1)).alias("rows"),
    )


@register
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_positions(spark, sf_dir).select("series_id", "ts", "pos", "n")
    trees = holdout(rows).withColumnRenamed("role", "row_role")
    return holdout(trees, lookback=24).select(
        "series_id", "ts", "row_role", F.col("role").alias("window_role")
    )


@register
def capped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 100 rows of each series, and of these the last 48 hours."""
    rows = events_positions(spark, sf_dir).select("series_id", "ts", "price", "pos", "n")
    return tidy(last_hours(last_rows(rows, 100), 48).select("series_id", "ts", "price"))


@register
def lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_positions(spark, sf_dir).select("series_id", "ts", "price", "load", "pos", "n")
    windows = lookback_windows(rows, ["price", "load"], 24)
    total = F.aggregate(
        F.flatten("window"), F.lit(0.0), lambda a, x: a + x.cast("double")
    )
    return tidy(
        windows.select(
            "series_id", "ts",
            F.size("window").alias("length"),
            total.alias("total"),
            F.array_join(F.transform("hours", lambda h: h.cast("string")), ",").alias("hours"),
            F.array_join(F.transform("weekdays", lambda d: d.cast("string")), ",").alias("weekdays"),
        )
    )


@register
def baseline_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(events_predictions(spark, sf_dir, (24, 72)))


@register
def walkforward_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events_predictions(spark, sf_dir, (24, 72))
    return tidy(accuracy(found, ["series_id", "model", "horizon", "fold"]))


@register
def multi_horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_positions(spark, sf_dir).select("series_id", "ts", "price", "pos", "n")
    found = baseline_predictions(rows, "price", [24, 168, 336, 744], 5)
    return tidy(walk_forward_ranking(found))


@register
def null_safe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both metric flavours where a model lacks some forecasts."""
    found = events_predictions(spark, sf_dir)
    gaps = found.withColumn("yhat", F.when(F.hour("ts") % 7 != 0, F.col("yhat") - 20))
    per_fold = accuracy(gaps, ["series_id", "model", "fold"], null_safe=True)
    mean = fold_mean(per_fold, ["series_id", "model"], skip_null=True)
    strict = accuracy(gaps, ["series_id", "model"]).select(
        "series_id", "model", F.col("MAE").alias("strict_MAE")
    )
    return tidy(mean.join(strict, ["series_id", "model"]))


@register
def kfold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events_predictions(spark, sf_dir, (24, 72), 3)
    per_fold = accuracy(found, ["series_id", "model", "horizon", "fold"], null_safe=True)
    summary = fold_summary(per_fold, ["series_id", "model", "horizon"])
    flat = summary.select(
        "series_id", "model", "horizon", "n_folds", "MAE", "RMSE", "MAPE",
        F.posexplode("folds.MAE").alias("fold", "fold_MAE"),
    )
    return tidy(flat)


@register
def block_backtest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_positions(spark, sf_dir).select("series_id", "ts", "price", "pos", "n")
    found = baseline_predictions(rows, "price", [168], 10, spare=0)
    return tidy(pooled_ranking(found))


@register
def health_of_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events_predictions(spark, sf_dir)
    gaps = found.withColumn("yhat", F.when(F.hour("ts") % 7 != 0, F.col("yhat")))
    return tidy(prediction_health(gaps, ["series_id", "model", "fold"]))


@register
def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events_predictions(spark, sf_dir)
    cut = {"persistence": 3, "seasonal_naive": 14, "mean24": 20}
    limit = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])[F.col("model")]
    gaps = found.withColumn("yhat", F.when(F.hour("ts") >= limit, F.col("yhat")))
    return tidy(model_coverage(gaps))


@register
def shared_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events_predictions(spark, sf_dir)
    # One series never has all models, which exercises the fallback.
    lost = (F.col("model") == "mean24") & ((F.hour("ts") % 5 == 0) | (F.col("series_id") == "view"))
    kept = common_timestamps(found.where(~lost), len(BASELINES))
    return tidy(kept.select("series_id", "ts", "model", "fold", "yhat"))


@register
def shared_timestamps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps that all models forecast, of forecasts without made gaps."""
    kept = common_timestamps(events_predictions(spark, sf_dir), len(BASELINES))
    return tidy(kept.select("series_id", "ts", "model", "fold", "yhat"))


# ---- merging --------------------------------------------------------------------------


def _two_forecast_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = events_predictions(spark, sf_dir, (24, 72))
    names = {"y": "Observed", "ts": "timestamp"}
    first = wide_predictions(found.where("horizon = 24"), ["persistence", "mean24"])
    second = wide_predictions(
        found.where("horizon = 72"), ["seasonal_naive", "mean24"]
    )
    return first.withColumnsRenamed(names), second.withColumnsRenamed(names)


@register
def merge_forecasts_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _two_forecast_tables(spark, sf_dir)
    second = second.withColumnRenamed("mean24", "mean24_long")
    return tidy(merge_forecasts(first, second, keys=["series_id", "timestamp"]))


@register
def merge_blocks_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _two_forecast_tables(spark, sf_dir)
    return tidy(
        merge_blocks(
            first, second, keys=["series_id", "timestamp"],
            models=["persistence", "seasonal_naive", "mean24"],
        )
    )


@register
def union_of_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = walk_forward_ranking(events_predictions(spark, sf_dir, (24, 72)))
    named = scores.withColumn("HorizonHours", F.col("horizon").cast("string")).drop("horizon")
    short = named.where("HorizonHours = '24'").drop("R2")
    long = named.where("HorizonHours = '72'")
    return tidy(union_rankings([short, long]))


def _with_place(ordered: DataFrame) -> DataFrame:
    """A sorted report (a row per model or pair) with the number of each row."""
    stored = materialise(ordered.withColumn("__at", F.monotonically_increasing_id()))
    return rank_sorted(stored.withColumn("__all", F.lit(0)), keys=["__all"], order=["__at"], position="place").drop("__at", "__all", "n")


@register
def rankings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked rankings in the order of their report."""
    scores = tidy(walk_forward_ranking(events_predictions(spark, sf_dir, (24, 72))))
    named = scores.withColumn("HorizonHours", F.col("horizon").cast("string")).drop("horizon")
    stacked = union_rankings([named.where("HorizonHours = '72'").drop("R2"), named.where("HorizonHours = '24'")])
    wanted = stacked.withColumn("model", F.concat_ws("/", "model", "series_id"))
    return _with_place(sort_rankings(materialise(wanted)).select("HorizonHours", "model"))


@register
def consolidated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two block forecast files and two ranking files, consolidated by the job and read back."""
    folder = _scratch(spark, "runs")
    found = events_predictions(spark, sf_dir, (24, 72)).where("series_id = 'view'")
    for name, horizon, models in (("short", 24, ["persistence", "mean24"]), ("long", 72, ["seasonal_naive", "mean24"])):
        wide = tidy(wide_predictions(found.where(F.col("horizon") == horizon), models)).drop("series_id")
        write_forecasts(wide.withColumnRenamed("y", "Observed"), f"{folder}/{name}.csv")
    inputs = ConsolidationInputs(forecasts={"all": ("short.csv", "long.csv")})
    out = f"{folder}/out"
    consolidate_job(spark, folder, inputs, out)
    back = spark.read.csv(f"{out}/forecasts_all", header=True)
    numbers = [c for c in back.columns if c != "timestamp"]
    return back.select(
        F.col("timestamp").try_cast("timestamp_ntz").alias("timestamp"),
        *[F.round(F.col(c).try_cast("double"), 5).alias(c) for c in numbers],
    )


# ---- peaks and comparisons ---------------------------------------------------------------


@register
def peak_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events_predictions(spark, sf_dir).where("model = 'mean24'")
    return tidy(peak_thresholds(found))


def _peaks(found: DataFrame) -> DataFrame:
    limits = peak_thresholds(found.where("model = 'mean24'"))
    return peak_metrics(found, limits)


@register
def peak_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_peaks(events_predictions(spark, sf_dir)))


@register
def peaks_over_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak metrics over one fixed threshold for all series."""
    found = events_predictions(spark, sf_dir)
    limits = peak_thresholds(found.where("model = 'mean24'"), fixed=60.0)
    return tidy(peak_metrics(found, limits))


@register
def month_peaks_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events_predictions(spark, sf_dir)
    best = best_peak_models(_peaks(found), q=0.95)
    return tidy(month_view(found, best))


@register
def dm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_predictions(events_predictions(spark, sf_dir), BASELINES)
    # A copy of a model has no loss difference: its pair is not testable.
    wide = wide.withColumn("copy24", F.col("mean24"))
    tests = diebold_mariano(wide, [*BASELINES, "copy24"])
    return tidy(tests.withColumns({c: F.col(c).cast("double") for c in ("n", "nw_lags")}))


@register
def dm_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of forecasts a day ahead with h - 1 lags, and with three lags and no correction."""
    wide = wide_predictions(events_predictions(spark, sf_dir), BASELINES)
    ahead = diebold_mariano(wide, list(BASELINES), h=24, auto_lags=False)
    raw = diebold_mariano(wide, list(BASELINES), lags=3, corrected=False)
    both = ahead.withColumn("variant", F.lit("h24")).unionByName(raw.withColumn("variant", F.lit("raw")))
    return tidy(both.withColumns({c: F.col(c).cast("double") for c in ("n", "nw_lags")}))


@register
def dm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the pairwise tests in the order of its report."""
    wide = wide_predictions(events_predictions(spark, sf_dir), BASELINES)
    shown = tidy(dm_summary(diebold_mariano(wide, list(BASELINES))))
    return _with_place(sorted_summary(materialise(shown)).select("series_id", "pair", "loss", "sig"))


@register
def dm_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_predictions(events_predictions(spark, sf_dir), BASELINES)
    return tidy(dm_summary(diebold_mariano(wide, list(BASELINES))))


# ---- rank fusion ---------------------------------------------------------------------------


def _weights(spark: SparkSession, sf_dir: str, lists: DataFrame) -> DataFrame:
    """Weights from the walk-forward error of the series a list is named after."""
    scores = walk_forward_ranking(events_predictions(spark, sf_dir, (72,)))
    rankings = scores.where("model = 'mean24'").select(
        F.col("series_id").alias("model"), F.col("horizon").alias("HorizonHours"), "MAE"
    )
    return model_weights(lists.select("model"), metric_table(rankings, horizon=72))


def _models(lists: DataFrame) -> list[str]:
    """Names of the lists, a row per model to the driver."""
    return [r["model"] for r in lists.select("model").distinct().orderBy("model").collect()]


@register
def rank_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = user_lists(spark, sf_dir)
    odd = F.when(F.col("pos") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "feature"))
    return rank_lists(lists.withColumn("feature", odd), aliases={"7": "8"})


@register
def rank_by_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists ranked by their importances instead of their order, which is by name here."""
    lists = user_lists(spark, sf_dir).withColumn("pos", F.col("feature").cast("long"))
    return rank_lists(lists, rank_by="importance")


@register
def weights_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_weights(spark, sf_dir, user_lists(spark, sf_dir)))


@register
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = user_lists(spark, sf_dir)
    return tidy(fuse(rank_lists(lists), _weights(spark, sf_dir, lists)))


@register
def heatmap_of_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = user_lists(spark, sf_dir)
    ranks = materialise(rank_lists(lists))
    fused = fuse(ranks, model_weights(ranks.select("model")))
    top = top_features(fused.withColumn("final_score", F.round("final_score", 9)))
    models = _models(ranks)
    return rank_heatmap(ranks, top, models).withColumns({m: F.col(m).cast("double") for m in models})


@register
def lists_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = user_lists(spark, sf_dir)
    frames = [
        lists.where(F.col("model") == m).select(
            "pos", F.col("feature").alias(f"{m}_feature"), F.col("importance").alias(f"{m}_importance")
        )
        for m in _models(lists)
    ]
    return tidy(side_by_side(frames))


# ---- decomposition and stationarity -----------------------------------------------------------


@register
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = events_panel(spark, sf_dir).select("series_id", "ts", "price")
    grid = with_positions(materialise(regularise(panel)))
    filled = forward_fill(grid, ["price"])
    parts = seasonal_decompose(filled, "price").select("series_id", "ts", "price", "trend", "seasonal", "resid")
    # Nine decimals: residuals of hundredths are often ties of the eighth.
    return tidy(parts.withColumn("resid", F.round("resid", 9).cast("string"))).withColumn("resid", F.col("resid").cast("double"))


@register
def kpss_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(kpss(events_panel(spark, sf_dir), "price"))


@register
def adf_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(adf(orders_panel(spark, sf_dir, by_priority=True), "price", step_seconds=DAY))


@register
def adf_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dickey-Fuller tests with no lag and with one."""
    panel = materialise(orders_panel(spark, sf_dir, by_priority=True))
    parts = [adf(panel, "price", step_seconds=DAY, lags=k) for k in (0, 1)]
    return tidy(parts[0].unionByName(parts[1]))


# ---- models ------------------------------------------------------------------------------------
#
# Boosting learns fast here and stops after four rounds without gain; depths, sampling, folds
# and repeats are the operators' own. Forests and searches are small: their sizes are parameters.
# The rows are all rows of the panel.

_RATE = 0.3

_MODEL_FEATURES = [
    "hour", "day_of_week", "sin24", "cos24", "price_roll24_mean", "price_roll24_std",
    "d_price_1h", "d_price_24h", "std_6h", "price_over_load", "import_share",
]


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with positions, stored."""
    rows = feature_table(events_panel(spark, sf_dir), drop_incomplete=False)
    wanted = rows.select("series_id", "ts", "price", *_MODEL_FEATURES).dropna("any")
    return materialise(with_positions(materialise(wanted)))


@register
def impute_with_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = regularise(events_panel(spark, sf_dir)).withColumn("hour", F.hour("ts").cast("double"))
    small = ForestSettings(num_trees=5, max_depth=5, target_depth=5, max_iter=2)
    numbers = ["hour", "load", "wind", "solar", "net_import", "total_gen"]
    return impute_forest(panel, "price", columns=numbers, settings=small)


@register
def features_imputed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature job: imputed, engineered, and imputed again."""
    small = ForestSettings(num_trees=5, max_depth=5, target_depth=5, max_iter=1)
    # Without these roles three feature families stay out, which keeps the second imputation small.
    roles = Roles(wind="none", up_reserve="none", wind_generation="none")
    panel = regularise(events_panel(spark, sf_dir))
    return build_features(panel, FeatureJob(roles=roles, forest=small))


@register
def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {"GBR": GradientBoosting(learning_rate=_RATE, patience=4)}
    return walk_forward(_model_rows(spark, sf_dir), models, "price", _MODEL_FEATURES, HORIZONS, N_SPLITS)


@register
def boosted_cv_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = CrossValidatedBoosting()
    model = CrossValidatedBoosting(
        patience=4, search=fast.search | {"stepSize": _RATE}, final=fast.final | {"stepSize": _RATE}
    )
    return walk_forward(_model_rows(spark, sf_dir), {"XGB": model}, "price", _MODEL_FEATURES, [24], N_SPLITS)


@register
def block_backtest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block backtest of a lookback model; predictions per block."""
    rows = orders_positions(spark, sf_dir)
    return block_backtest(rows, {"window": WindowRegression()}, "price", ["price", "load"])


@register
def linear_ar_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(events_positions(spark, sf_dir))
    horizons = [72, *HORIZONS]  # short tables have no room for the long ones
    plain = seasonal_autoregression(rows, "price", horizons, N_SPLITS, name="SARIMA")
    more = seasonal_autoregression(rows, "price", horizons, N_SPLITS, name="SARIMAX", exogenous=["load"])
    return plain.unionByName(more)


@register
def ar_one_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal autoregression with one lag, which plain SQL can roll out too."""
    rows = materialise(events_positions(spark, sf_dir))
    found = seasonal_autoregression(rows, "price", [24, 72], N_SPLITS, lags=(1,))
    return tidy(found.select("series_id", "horizon", "fold", "ts", "model", "yhat"))


@register
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = {"maxIter": (2, 4), "stepSize": (0.1, 0.3), "maxDepth": (2, 3)}
    search = RandomSearch(grid=grid, draws=2, splits=2, horizon=24)
    found = search.scores(_model_rows(spark, sf_dir), "price", _MODEL_FEATURES)
    rows = [(i, *[float(p[k]) for k in grid], score) for i, (p, score) in enumerate(found)]
    return spark.createDataFrame(rows, "draw int, maxIter double, stepSize double, maxDepth double, MAE double")


@register
def arma_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal models with moving-average terms, all series, horizons and folds."""
    rows = materialise(events_positions(spark, sf_dir))
    plain = walk_forward(rows, {"SARIMA": SeasonalArma()}, "price", [], [72], N_SPLITS)
    more = walk_forward(
        rows, {"SARIMAX": SeasonalArma(SARIMAX_ORDER, SARIMAX_SEASONAL)}, "price", ["load", "net_import"], [72], N_SPLITS
    )
    return plain.unionByName(more)


@register
def perm_importance_sarimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of the exogenous columns of the seasonal model."""
    model = SeasonalArma(SARIMAX_ORDER, SARIMAX_SEASONAL)
    found = permutation_importance(events_positions(spark, sf_dir), model, "price", ["load", "net_import", "up_reserve"])
    return top_importance(found)


_PLANE = ["load", "net_import"]


@register
def perm_importance_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance in the last week of a linear model, per series."""
    rows = events_positions(spark, sf_dir)
    return tidy(permutation_importance(rows, LeastSquares(), "price", _PLANE, by=["series_id"]))


@register
def perm_importance_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance over all rows of a linear model, fitted on the same."""
    return tidy(permutation_importance(events_positions(spark, sf_dir), LeastSquares(), "price", _PLANE, window=None))


@register
def walk_forward_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward forecasts of a linear model over all series, every horizon and fold."""
    rows = events_positions(spark, sf_dir)
    return tidy(walk_forward(rows, {"plane": LeastSquares()}, "price", _PLANE, HORIZONS, N_SPLITS).drop("error", "y"))


@register
def block_backtest_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten weeks, a linear model refitted before each."""
    rows = orders_positions(spark, sf_dir)
    return tidy(block_backtest(rows, {"line": LeastSquares()}, "price", ["load"]).drop("error", "y"))


@register
def failed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block backtest in which two series carry infinite values; the forecasts that fail for it."""
    rows = events_positions(spark, sf_dir)
    at = F.when(F.col("series_id") == "click", F.lit(0)).when(F.col("series_id") == "view", F.col("n") - 200)
    spoilt = rows.withColumn("load", F.when(F.col("pos") == at, F.lit(float("inf"))).otherwise(F.col("load")))
    return failures(block_backtest(spoilt, {"plane": LeastSquares()}, "price", _PLANE, block=48, blocks=5))


@register
def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = GradientBoosting(learning_rate=_RATE, patience=4)
    return top_importance(permutation_importance(_model_rows(spark, sf_dir), model, "price", _MODEL_FEATURES))


@register
def perm_importance_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = GradientBoosting(learning_rate=_RATE, patience=4)
    return top_importance(permutation_importance(_model_rows(spark, sf_dir), model, "price", _MODEL_FEATURES, window=None))


@register
def perm_importance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    model = WindowRegression()
    fitted = model.fit(rows.where(F.col("pos") < F.col("n") - 168), "price", _MODEL_FEATURES)
    return window_importance(fitted, rows, "price", _MODEL_FEATURES, context=model.context)
