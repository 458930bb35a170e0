"""Test-statistic helpers: p-values, significance marks, lag rules.

The two p-value functions run on aggregated results (a row per series and model
pair), never on panel rows, so an Arrow-batched pandas function is enough.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import as_column


def _normal_tail(x: float) -> float:
    return math.erfc(abs(x) / math.sqrt(2.0))


def _student_tail(x: float, df: float) -> float:
    """P(|T| > |x|) as the regularised incomplete beta I_z(df/2, 1/2), z = df/(df+x^2)."""
    if not math.isfinite(x) or not df > 0:
        return math.nan
    if x == 0.0:
        return 1.0
    a, b, z = df / 2.0, 0.5, df / (df + x * x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(z) + b * math.log1p(-z)
    )
    if z < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, z) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - z) / b


def _beta_fraction(a: float, b: float, z: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * z / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for term in (
            m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def normal_two_sided(stat) -> Column:
    """Two-sided normal p-value."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: _normal_tail(v) if pd.notna(v) else None).astype(float)

    return _nullable(tail(as_column(stat)))


def student_two_sided(stat, df) -> Column:
    """Two-sided Student-t p-value."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        pairs = zip(x.to_numpy(float), k.to_numpy(float))
        return pd.Series([_student_tail(v, n) if np.isfinite(v) else np.nan for v, n in pairs])

    return _nullable(tail(as_column(stat), as_column(df).cast("double")))


def _nullable(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def significance_stars(p) -> Column:
    p = as_column(p)
    return (
        F.when(p.isNull() | F.isnan(p), F.lit(""))
        .when(p < 1e-3, F.lit("***"))
        .when(p < 1e-2, F.lit("**"))
        .when(p < 5e-2, F.lit("*"))
        .otherwise(F.lit(""))
    )


def newey_west_lags(n) -> Column:
    """floor(4 (n/100)^(2/9)) as an integer column."""
    return F.floor(F.lit(4.0) * F.pow(as_column(n) / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")


def newey_west_lags_of(n: int) -> int:
    return int(math.floor(4.0 * (n / 100.0) ** (2.0 / 9.0)))
