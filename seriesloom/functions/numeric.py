"""Numeric coercion, ratios and the signed logarithm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .time import as_column

RATIO_EPSILON = 1e-9


def null_if_nan(c) -> Column:
    """NaN becomes NULL: Spark aggregates skip NULL but propagate NaN."""
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(c) for c in floats}) if floats else df


def to_number(c) -> Column:
    """Text to double: spaces and no-break spaces go, a comma is a decimal point."""
    text = F.translate(as_column(c).cast("string"), ", \u00a0", ".")
    return null_if_nan(text.try_cast("double"))


def safe_ratio(a, b) -> Column:
    """``a / b`` with a zero denominator giving NULL."""
    b = as_column(b)
    return as_column(a) / (F.when(b != 0, b) + F.lit(RATIO_EPSILON))


def signed_log1p(c) -> Column:
    c = as_column(c)
    return F.signum(c) * F.log1p(F.abs(c))


def inverse_signed_log1p(c) -> Column:
    c = as_column(c)
    return F.signum(c) * F.expm1(F.abs(c))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Names of numeric columns in schema order, each once, minus ``exclude``."""
    skip, seen = set(exclude), []
    for field in df.schema:
        if isinstance(field.dataType, T.NumericType) and field.name not in skip:
            if field.name not in seen:
                seen.append(field.name)
    return seen
