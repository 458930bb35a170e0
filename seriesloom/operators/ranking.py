"""Rank fusion: feature lists of several models to one score per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import to_number
from ..functions.text import canonical_model, clean_label
from ..functions.time import floor_div
from ..session import materialise
from .positions import BUCKET_ROWS, rank_in_buckets, rank_sorted

# Constant of reciprocal rank fusion, plot size, metric rounding.
RRF_K = 60
TOP_FEATURES = 15
METRIC_DECIMALS = 6
DEFAULT_METRIC = "MAE"
DEFAULT_HORIZON = 168


def feature_columns(wide: DataFrame) -> dict[str, str]:
    """``*_feature`` columns of a merged importance table, with their model names."""
    return {c: canonical_model(c) for c in wide.columns if c.lower().endswith("_feature")}


def unpivot_lists(wide: DataFrame, *, pos: str = "pos") -> DataFrame:
    """``model, pos, feature`` from a wide table; empty models vanish, two must remain."""
    names = feature_columns(wide)
    if len(names) < 2:
        raise ValueError(f"need two '*_feature' columns, have {list(names)}")
    entries = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).alias("feature")) for c, m in names.items()]
    )
    return wide.select(pos, F.explode(entries).alias("e")).select("e.model", pos, "e.feature")


def rank_lists(
    lists: DataFrame,
    *,
    aliases: dict[str, str] | None = None,
    rank_by: str = "position",
    pos: str = "pos",
) -> DataFrame:
    """``model, feature, rank`` from ``model, pos, feature`` (and ``importance``).

    Labels are trimmed, empty ones dropped, aliases applied, and the first of
    equal labels kept; the rank counts what is left in list order. With
    ``rank_by='importance'`` the list order is by descending importance instead.
    """
    cleaned = lists.withColumn("feature", clean_label("feature", aliases)).where("feature IS NOT NULL")
    if rank_by == "importance":
        cleaned = cleaned.withColumn("__order", -F.col("importance"))
        first = cleaned.groupBy("model", "feature").agg(
            F.min(F.struct("__order", pos)).alias("__at")
        ).select("model", "feature", "__at.*")
        ranked = rank_sorted(first, keys=["model"], order=["__order", pos, "feature"], position="__place", size="__size")
        return ranked.select("model", "feature", (F.col("__place") + 1).cast("int").alias("rank"))
    first = cleaned.groupBy("model", "feature").agg(F.min(pos).alias(pos))
    ranked = rank_in_buckets(
        first, keys=["model"], bucket=floor_div(F.col(pos), BUCKET_ROWS), order=[pos],
        position="__place", size="__size",
    )
    return ranked.select("model", "feature", (F.col("__place") + 1).cast("int").alias("rank"))


def metric_table(
    rankings: DataFrame, *, metric: str = DEFAULT_METRIC, horizon: int = DEFAULT_HORIZON
) -> DataFrame:
    """Metrics of one horizon, rounded; missing columns are an error."""
    missing = {"model", "HorizonHours", metric} - set(rankings.columns)
    if missing:
        raise KeyError(f"missing columns {sorted(missing)}")
    numbers = [c for c in ("MAE", "RMSE", "MAPE", "RMSLE", "R2") if c in rankings.columns]
    wanted = rankings.where(to_number("HorizonHours") == horizon)
    return wanted.withColumns({c: F.round(to_number(c), METRIC_DECIMALS) for c in numbers})


def model_weights(
    models: DataFrame,
    metrics: DataFrame | None = None,
    *,
    metric: str = DEFAULT_METRIC,
    renormalise: bool = False,
) -> DataFrame:
    """``model, w``: inverse-error weights for the models that have a metric.

    A model with several rows counts by its smallest error. Models without one keep ``1/number of models``, so the total may exceed one;
    ``renormalise`` divides by the total. Without metrics all weights are equal.
    """
    every = Window.partitionBy()  # a row per model
    listed = models.select("model").distinct().withColumn("__n", F.count(F.lit(1)).over(every))
    equal = 1 / F.col("__n")
    if metrics is None:
        return listed.select("model", equal.alias("w"))
    errors = metrics.groupBy("model").agg(
        F.min(metric).alias("__e"), F.lit(True).alias("__matched")
    )
    joined = listed.join(errors, ["model"], "left")
    inverse = F.when(F.col("__matched"), F.coalesce(F.when(F.col("__e") != 0, 1 / F.col("__e")), F.lit(0.0)))
    joined = joined.withColumn("__inv", inverse)
    joined = joined.withColumns(
        {"__total": F.sum("__inv").over(every), "__hits": F.count("__inv").over(every)}
    )
    share = F.when(F.col("__total") > 0, F.col("__inv") / F.col("__total")).otherwise(1 / F.col("__hits"))
    weighted = joined.select("model", F.when(F.col("__matched"), share).otherwise(equal).alias("w"))
    if not renormalise:
        return weighted
    return weighted.withColumn("w", F.col("w") / F.sum("w").over(every))


def _scaled(column: str, lo: str, hi: str) -> Column:
    low, high = F.col(lo), F.col(hi)
    return F.when(high == low, 0.0).otherwise((F.col(column) - low) / (high - low))


def fuse(ranks: DataFrame, weights: DataFrame) -> DataFrame:
    """Borda, weighted Borda, reciprocal rank and rank statistics per feature.

    Every feature has at most one rank per model, so the groups are as small as
    the model list. Maxima and score ranges are scalar subqueries.
    """
    top = ranks.agg(F.max("rank")).scalar()
    models = ranks.agg(F.count_distinct("model")).scalar()
    placed = (
        ranks.join(weights, ["model"], "left")
        .withColumns({"__top": top, "__models": models})
        .withColumn("w", F.coalesce("w", 1 / F.col("__models")))
    )
    points = F.col("__top") + 1 - F.col("rank")
    scores = placed.groupBy("feature").agg(
        F.sum(points).alias("borda"),
        F.sum(F.col("w") * points).alias("wborda"),
        F.sum(F.col("w") / (RRF_K + F.col("rank"))).alias("rrf"),
        F.avg("rank").alias("mean_rank"),
        F.percentile("rank", F.lit(0.5)).alias("median_rank"),
        F.count_distinct("model").alias("models_count"),
        (F.count_distinct("model") / F.first("__models")).alias("models_frac"),
    )
    scores = materialise(scores)  # a row per feature, read again for the score ranges
    fused = ("borda", "wborda", "rrf")
    span = F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in fused])
    out = scores.withColumn("__span", scores.agg(span).scalar())
    out = out.withColumns({f"{c}_norm": _scaled(c, f"__span.{c}.lo", f"__span.{c}.hi") for c in fused})
    score = (F.col("wborda_norm") + F.col("rrf_norm")) / 2
    return out.withColumn("final_score", score).drop("__span")


def top_features(fused: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """Best features by final score; equal scores are settled by name."""
    return fused.orderBy(F.col("final_score").desc(), "feature").limit(top)


def rank_heatmap(ranks: DataFrame, features: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per listed feature and one column per model with its best rank."""
    wanted = ranks.join(features.select("feature"), ["feature"], "left_semi")
    cells = [F.min(F.when(F.col("model") == m, F.col("rank"))).alias(m) for m in models]
    return wanted.groupBy("feature").agg(*cells)
