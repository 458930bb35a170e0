"""Panels, forecasts and lists derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import DAY
from ..operators.baselines import baseline_predictions
from ..operators.grid import to_panel
from ..operators.positions import rank_sorted, with_positions
from ..session import materialise

# Results are shown with about ten significant digits: the order of additions, which Spark does not
# fix, moves a double by far less. Pairs of an upper bound and the decimals kept below it.
PRECISION = ((1e2, 8), (1e4, 6), (1e6, 4), (1e8, 2))
BASELINES = ("persistence", "seasonal_naive", "mean24")


def exact_sum(c) -> Column:
    """Sum as DECIMAL with six places, so that it does not depend on the order of the rows."""
    return F.sum(c.cast("decimal(20,6)")).cast("double")


def presented(c: Column) -> Column:
    """``c`` at the precision in which results are shown; adding zero turns -0.0 into 0.0."""
    shown = F.round(c, 0)
    for bound, decimals in reversed(PRECISION):
        shown = F.when(F.abs(c) < bound, F.round(c, decimals)).otherwise(shown)
    return shown + F.lit(0.0)


def tidy(df: DataFrame) -> DataFrame:
    """Every double of a result as it is presented."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: presented(F.col(c)) for c in doubles}) if doubles else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panel of ``events``, a series per event type; scanned once and stored."""
    value, user = F.col("value"), F.col("user_id")
    columns = {
        "price": exact_sum(value) / F.count(value),
        "load": F.count(F.lit(1)).cast("double"),
        "wind": exact_sum(F.when(user % 3 == 0, value)),
        "solar": exact_sum(F.when(user % 3 == 1, value)),
        "net_import": F.max(value) - F.min(value),
        "up_reserve": F.max(value),
        "down_reserve": F.min(value),
        "total_gen": exact_sum(value),
    }
    raw = table(spark, sf_dir, "events").select("event_type", "ts", "user_id", "value")
    return materialise(to_panel(raw, series="event_type", ts="ts", columns=columns))


def orders_panel(spark: SparkSession, sf_dir: str, *, by_priority: bool = False) -> DataFrame:
    """Daily panel of ``orders``: one long series, or one per priority."""
    columns = {
        "price": exact_sum(F.col("o_totalprice")) / F.count("o_totalprice"),
        "load": F.count(F.lit(1)).cast("double"),
    }
    key = F.col("o_orderpriority") if by_priority else F.lit("orders")
    raw = table(spark, sf_dir, "orders")
    return materialise(
        to_panel(raw, series=key, ts="o_orderdate", columns=columns, step_seconds=DAY)
    )


def events_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(events_panel(spark, sf_dir))


def orders_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(orders_panel(spark, sf_dir), step_seconds=DAY)


def events_predictions(
    spark: SparkSession, sf_dir: str, horizons=(72,), splits: int = 5
) -> DataFrame:
    """Baseline walk-forward forecasts of the hourly panel, stored."""
    rows = events_positions(spark, sf_dir).select("series_id", "ts", "price", "pos", "n")
    return materialise(baseline_predictions(rows, "price", list(horizons), splits))


def user_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type its users by value sum, as ranked lists."""
    sums = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("model"), F.col("user_id").cast("string").alias("feature"))
        .agg(exact_sum(F.col("value")).alias("importance"))
    )
    ranked = rank_sorted(sums, keys=["model"], order=[F.col("importance").desc(), F.col("feature").cast("long")])
    return materialise(ranked.select("model", (F.col("pos") + 1).alias("pos"), "feature", "importance"))
