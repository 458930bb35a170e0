"""Standardisation with population moments of the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import inverse_signed_log1p, signed_log1p
from ..functions.time import as_column


Moments = dict[str, tuple[float, float]]


def moments(df: DataFrame, columns: Sequence[str], *, train: Column | None = None) -> Moments:
    """Mean and scale of each column over the training rows; a constant column has scale 1.

    One aggregate row reaches the driver, so applying the scaling needs no join.
    """
    rows = df if train is None else df.where(train)
    out = []
    for c in columns:
        std = F.stddev_pop(c)
        out += [F.avg(c), F.when(std > 0, std).otherwise(1.0)]
    row = rows.agg(*out).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def standardised(c: str, fitted: Moments) -> Column:
    mean, scale = fitted[c]
    return (F.col(c) - F.lit(mean)) / F.lit(scale)


def standardise(df: DataFrame, columns: Sequence[str], fitted: Moments) -> DataFrame:
    """Replace columns by their z-scores."""
    return df.withColumns({c: standardised(c, fitted) for c in columns})


def unstandardise(c, mean: float, scale: float) -> Column:
    return as_column(c) * F.lit(scale) + F.lit(mean)


def scale_signed_log(
    df: DataFrame, column: str, *, train: Column | None = None, out: str = "scaled"
) -> DataFrame:
    """Signed log, z-score with training moments, and the value restored from it."""
    logged = df.withColumn("__log", signed_log1p(column))
    fitted = moments(logged, ["__log"], train=train)
    back = inverse_signed_log1p(unstandardise(out, *fitted["__log"]))
    scored = logged.withColumn(out, standardised("__log", fitted))
    return scored.withColumn("restored", back).drop("__log")
