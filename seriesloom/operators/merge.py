"""Merging forecast tables, importance lists and rankings of different runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_number

# Model columns of a forecast table, and their order after a block merge.
FORECAST_MODELS = ("XGB", "GBR", "SARIMA", "SARIMAX", "Transformer", "TiDE", "Seq2Seq", "AutoML")


def coerce_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to numbers; absent names are ignored."""
    present = {c: to_number(c) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def _merge(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys``; a column on both sides becomes ``coalesce(left, right)``."""
    both = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in both})
    joined = left.join(renamed, list(keys), how)
    merged = {c: F.coalesce(F.col(c), F.col(f"__right_{c}")) for c in both}
    return joined.withColumns(merged).drop(*[f"__right_{c}" for c in both]) if both else joined


def merge_forecasts(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str] = ("timestamp",), observed: str = "Observed"
) -> DataFrame:
    """Full outer merge of two wide forecast tables: keys, observed, then models by name.

    The observed value comes from the left table, else from the right one, so
    timestamps that only the right table has keep their observation.
    """
    merged = _merge(left, right, keys, "full")
    models = sorted(c for c in merged.columns if c not in (*keys, observed))
    return merged.select(*keys, *[c for c in (observed,) if c in merged.columns], *models)


def merge_blocks(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("timestamp",),
    observed: str = "Observed",
    models: Sequence[str] = FORECAST_MODELS,
) -> DataFrame:
    """Inner merge of two block forecasts; a model on both sides is taken from the left."""
    both = [c for c in models if c in left.columns and c in right.columns]
    merged = _merge(left, right.drop(*both), keys, "inner")
    order = [*keys, observed, *models]
    return merged.select(*[c for c in order if c in merged.columns])


def side_by_side(frames: Sequence[DataFrame], *, pos: str = "pos") -> DataFrame:
    """Put lists next to each other by position; shorter ones are padded with NULL."""
    return reduce(lambda a, b: a.join(b, [pos], "full"), frames)


def union_rankings(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack ranking tables by column name; horizon to integer and MAE to number."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if "HorizonHours" in stacked.columns:
        stacked = stacked.withColumn("HorizonHours", to_number("HorizonHours").cast("long"))
    return coerce_columns(stacked, ["MAE"])


def sort_rankings(stacked: DataFrame) -> DataFrame:
    """Sink order: horizon, MAE, then model to settle ties."""
    wanted = [c for c in ("HorizonHours", "MAE", "model") if c in stacked.columns]
    return stacked.orderBy(*[F.col(c).asc_nulls_last() for c in wanted])
