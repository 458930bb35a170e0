"""Profiling of wide tables and pruning of columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import numeric_columns
from ..session import materialise
from .quantiles import exact_quantiles, finite

# Threshold of a high correlation, quantiles of the summary, and the
# price pair of which the first is always kept.
HIGH_CORRELATION = 0.95
SUMMARY_QUANTILES = (0.25, 0.5, 0.75)
KEEP_FIRST_OF = ("fixing_i_price", "fixing_ii_price")
CORRELATIONS = "i int, j int, feature_1 string, feature_2 string, corr double"
SUMMARY = "column_name string, mean double, std double, min double, p25 double, p50 double, p75 double, max double"


def missing_report(df: DataFrame) -> DataFrame:
    """``column_name, rows, missing, missing_pct`` for all columns in one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"__m{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"__m{i}").alias("missing"))
        for i, c in enumerate(df.columns)
    ]
    flat = counts.select("__rows", F.explode(F.array(*entries)).alias("e"))
    share = F.col("e.missing") / F.greatest(F.col("__rows"), F.lit(1)) * 100
    return flat.select(
        F.col("e.column_name").alias("column_name"),
        F.col("__rows").alias("rows"),
        F.col("e.missing").alias("missing"),
        F.round(share, 2).alias("missing_pct"),
    )


def unpivot_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    return df.select(F.explode(F.array(*entries)).alias("e")).select("e.column_name", "e.value")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, std, min, exact quartiles and max of each numeric column."""
    names = list(columns or numeric_columns(df))
    if not names:
        return df.sparkSession.createDataFrame([], SUMMARY)
    # One wide scan for the moments and the extent of all columns, then the long table for ranks only.
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.count(finite(v)).alias("n"),
            F.min(finite(v)).alias("low"), F.max(finite(v)).alias("high"),
        )
        for c, v in ((c, F.col(c).cast("double")) for c in names)
    ]
    moments = materialise(df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*"))
    found = exact_quantiles(
        unpivot_numeric(df, names), keys=["column_name"], value="value", qs=SUMMARY_QUANTILES, few_keys=True,
        extent=moments.select("column_name", "n", "low", "high"),
    )
    quartiles = found.groupBy("column_name").agg(
        *[
            F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(f"p{int(q * 100)}")
            for q in SUMMARY_QUANTILES
        ]
    )
    return moments.join(quartiles, ["column_name"], "left").select(
        "column_name", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, constant``: no two different values, NULLs ignored, any type."""
    names = list(columns or df.columns)
    flags = df.agg(
        *[
            F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"__c{i}")
            for i, c in enumerate(names)
        ]
    )
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"__c{i}").alias("constant"))
        for i, c in enumerate(names)
    ]
    return flags.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def drop_constant(
    df: DataFrame, columns: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Drop constant numeric columns (or of ``columns``); returns the table and the names."""
    names = list(columns or numeric_columns(df))
    if not names:
        return df, []
    removed = [r["column_name"] for r in constant_columns(df, names).where("constant").collect()]
    return df.drop(*removed), [c for c in names if c in removed]


def _cross_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's moments over the rows that have both columns of a pair: count, means, spreads.

    Known values, less the means of the task's first rows, are a matrix with zeros
    elsewhere, and which are known is another; the sums of all pairs are products of the two.
    """
    centre, total = None, None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
        values = np.column_stack(columns)
        known = ~np.isnan(values)
        if centre is None:
            centre = np.where(known, values, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
            total = np.zeros((4, len(centre), len(centre)))
        values = np.where(known, values - centre, 0.0)
        there = known.astype(float)
        total += [there.T @ there, values.T @ there, (values * values).T @ there, values.T @ values]
    if centre is None:
        return
    i, j = np.triu_indices(len(centre), 1)
    n, first, squares, both = (t[i, j] for t in total)
    other, other_squares = total[1][j, i], total[2][j, i]
    some = n > 0
    i, j, n, first, other = i[some], j[some], n[some], first[some], other[some]
    cells = [
        i.astype(np.int32), j.astype(np.int32), n, centre[i] + first / n, centre[j] + other / n,
        squares[some] - first * first / n, other_squares[some] - other * other / n, both[some] - first * other / n,
    ]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])


def absolute_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``i, j, feature_1, feature_2, corr`` for i < j, pairwise complete; NaN counts as missing.

    One scan whatever the number of columns: every task gives the moments of all pairs
    around its own means, and these rows, one per pair and task, are put together around
    the common means, so no digits are lost to a large level. Constant columns, and pairs
    without a common row, have no correlation.
    """
    names = list(columns or numeric_columns(df))
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(names)])
    kinds = "i int, j int, n double, x double, y double, xx double, yy double, xy double"
    parts = materialise(numbers.mapInArrow(_cross_products, kinds))
    n = F.sum("n")
    common = parts.groupBy("i", "j").agg(
        (F.sum(F.col("n") * F.col("x")) / n).alias("mx"), (F.sum(F.col("n") * F.col("y")) / n).alias("my")
    )
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    # What is left of equal values are rounding errors, of the order of the values' own last digits.
    noise = 1e-12
    sums = parts.join(common, ["i", "j"]).groupBy("i", "j").agg(
        F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"),
        (n * F.max(F.col("mx") * F.col("mx")) * noise**2).alias("zx"), (n * F.max(F.col("my") * F.col("my")) * noise**2).alias("zy"),
    )
    varies = (F.col("xx") > F.col("zx")) & (F.col("yy") > F.col("zy"))
    corr = F.least(F.abs(F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))), F.lit(1.0))
    pairs = [(i, j) for j in range(len(names)) for i in range(j)]
    if not pairs:
        return df.sparkSession.createDataFrame([], CORRELATIONS)
    every = df.sparkSession.createDataFrame(
        [(i, j, names[i], names[j]) for i, j in pairs], "i int, j int, feature_1 string, feature_2 string"
    )
    return every.join(sums.select("i", "j", F.when(varies, corr).alias("corr")), ["i", "j"], "left")


def correlated_pairs(
    df: DataFrame, threshold: float = HIGH_CORRELATION, columns: Sequence[str] | None = None
) -> DataFrame:
    """Pairs whose absolute correlation reaches ``threshold``."""
    found = absolute_correlations(df, columns).where(F.col("corr") >= threshold)
    return found.select("feature_1", "feature_2", "corr")


def mean_correlation(pairs: DataFrame) -> DataFrame:
    """Mean absolute correlation of each column, its own 1 included."""
    ends = F.array(F.col("feature_1"), F.col("feature_2"))
    long = pairs.select(F.explode(ends).alias("column_name"), "corr")
    return long.groupBy("column_name").agg(
        ((F.sum("corr") + 1) / (F.count("corr") + 1)).alias("mean_abs_corr")
    )


def columns_to_drop(
    pairs: DataFrame,
    names: Sequence[str],
    *,
    threshold: float = HIGH_CORRELATION,
    protected: Sequence[str] = (),
) -> list[str]:
    """The columns that a table of pair correlations condemns, in the order of ``names``.

    Each column forms a group with its earlier partners at or above the threshold. A
    group gives up its unprotected member of highest mean correlation; ties go to the
    column itself, then to the earliest partner. A group with both price columns of
    ``KEEP_FIRST_OF`` gives up the second one instead, if unprotected.
    """
    keep, drop = KEEP_FIRST_OF
    place = F.create_map(*[F.lit(v) for i, c in enumerate(names) for v in (c, i)])
    tied = pairs.where(F.col("corr") >= threshold).select(
        F.greatest(place[F.col("feature_1")], place[F.col("feature_2")]).alias("group"), F.array("feature_1", "feature_2").alias("members")
    )
    groups = tied.select("group", F.explode("members").alias("column_name")).distinct().join(mean_correlation(pairs), "column_name")
    at = place[F.col("column_name")]
    free = ~F.col("column_name").isin(list(protected))
    standing = F.struct("mean_abs_corr", at == F.col("group"), -at)
    both = F.bool_or(F.col("column_name") == keep) & F.bool_or(F.col("column_name") == drop)
    given_up = groups.groupBy("group").agg(
        F.when(both, F.lit(None if drop in protected else drop))
        .otherwise(F.max_by("column_name", F.when(free, standing)))
        .alias("out")
    )
    out = {r["out"] for r in given_up.where("out IS NOT NULL").distinct().collect()}
    return [c for c in names if c in out]


def drop_correlated(
    df: DataFrame,
    *,
    threshold: float = HIGH_CORRELATION,
    protected: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Prune highly correlated columns; only the condemned names reach the driver."""
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        return df, []
    dropped = columns_to_drop(
        materialise(absolute_correlations(df, names)), names, threshold=threshold, protected=protected
    )
    return df.drop(*dropped), dropped
