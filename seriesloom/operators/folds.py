"""Walk-forward folds, blocks, holdouts and lookback windows of positioned panels.

All of them are arithmetic on ``pos`` and ``n``; no further shuffle is needed.
Fold ``i`` of ``s`` tests the rows ``[n-(s-i)h, n-(s-i-1)h)`` and trains on every
earlier row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_ROWS, over_chunks

# Default horizons in hours (1, 7, 14, 31 days) and split counts.
HORIZONS = (24, 168, 336, 744)
N_SPLITS = 5
BLOCK_ROWS = 168
N_BLOCKS = 10


def per_horizon(df: DataFrame, horizons: Sequence[int], splits: int, spare: int) -> DataFrame:
    """One copy per horizon the series is long enough for: n > h (splits + spare)."""
    fits = F.col("n") > F.col("horizon") * (splits + spare)
    values = F.array(*[F.lit(int(h)) for h in horizons])
    return df.withColumn("horizon", F.explode(values)).where(fits)


def fold_start(splits: int) -> Column:
    """Position of the first test row of fold 0."""
    return F.col("n") - F.col("horizon") * splits


def test_rows(
    df: DataFrame, horizons: Sequence[int], splits: int = N_SPLITS, *, spare: int = 1
) -> DataFrame:
    """Test rows with ``horizon`` and ``fold``. A row tests at most one fold per horizon."""
    latest = df.where(F.col("pos") >= F.col("n") - max(horizons) * splits)
    offset = F.col("pos") - fold_start(splits)
    return (
        per_horizon(latest, horizons, splits, spare)
        .where(offset >= 0)
        .withColumn("fold", F.floor(offset / F.col("horizon")).cast("int"))
    )


def block_rows(df: DataFrame, block: int = BLOCK_ROWS, blocks: int = N_BLOCKS) -> DataFrame:
    """Rows of the last ``blocks`` blocks; only more than ``block * blocks`` rows are needed."""
    return test_rows(df, [block], blocks, spare=0)


def fold_table(
    df: DataFrame,
    horizons: Sequence[int],
    splits: int = N_SPLITS,
    *,
    context: int = 0,
    spare: int = 1,
) -> DataFrame:
    """Every row once per fold it trains or tests.

    ``is_context`` marks the ``context`` training rows right before the test
    rows, which a lookback model prepends to the test part. Training rows are
    repeated per fold, so use ``test_rows`` plus prefix sums where a model allows
    it.
    """
    start = fold_start(splits) + F.col("fold") * F.col("horizon")
    position = F.col("pos")
    return (
        per_horizon(df, horizons, splits, spare)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        .where(position < start + F.col("horizon"))
        .withColumn("role", F.when(position < start, F.lit("train")).otherwise(F.lit("test")))
        .withColumn("is_context", (position < start) & (position >= start - context))
    )


def fold_bounds(
    df: DataFrame,
    horizons: Sequence[int],
    splits: int,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    spare: int = 1,
) -> DataFrame:
    """One row per series, horizon and fold: train size and the test range."""
    tested = test_rows(df, horizons, splits, spare=spare)
    return tested.groupBy(*series, "horizon", "fold").agg(
        F.min("pos").alias("train_rows"),
        F.count(F.lit(1)).alias("test_rows"),
        F.min(ts).alias("test_from"),
        F.max(ts).alias("test_to"),
    )


def holdout(df: DataFrame, fraction: float = 0.1, *, lookback: int | None = None) -> DataFrame:
    """Mark the last part of each series as ``valid``.

    Without ``lookback``: the rows from ``int(n (1 - fraction))`` on. With it: the
    rows are the ends of lookback windows, of which the last
    ``max(1, int(fraction m))`` are held out; rows before the first full window
    have no role.
    """
    if lookback is None:
        cut = F.floor(F.col("n") * F.lit(1 - fraction))
        return df.withColumn("role", F.when(F.col("pos") < cut, "train").otherwise("valid"))
    windows = F.col("n") - (lookback - 1)
    held = F.greatest(F.lit(1), F.floor(windows * F.lit(fraction)))
    role = (
        F.when(F.col("pos") < lookback - 1, F.lit(None).cast("string"))
        .when(F.col("pos") < F.col("n") - held, F.lit("train"))
        .otherwise(F.lit("valid"))
    )
    return df.withColumn("role", role)


def lookback_windows(
    df: DataFrame,
    columns: Sequence[str],
    lookback: int,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    keep_short: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The last ``lookback`` rows of features, hours and weekdays for each row.

    Rows with a shorter past are dropped for fitting, or kept with NULL windows
    for prediction. The arrays make the output ``lookback`` times as large: write
    it or feed it to the model at once, do not shuffle it.
    """

    def build(w):
        frame = w.rowsBetween(-(lookback - 1), 0)
        gathered = F.collect_list(F.array(*[F.col(c).cast("float") for c in columns])).over(frame)
        full = F.col("pos") >= lookback - 1
        return {
            "window": F.when(full, gathered),
            "hours": F.when(full, F.collect_list(F.hour(ts)).over(frame)),
            "weekdays": F.when(full, F.collect_list(F.weekday(ts)).over(frame)),
        }

    out = over_chunks(df, build, series=series, before=lookback - 1, chunk_rows=chunk_rows)
    return out if keep_short else out.where(F.col("pos") >= lookback - 1)


def segment(splits: int) -> Column:
    """-1 before the first test row, then the fold that tests the row."""
    offset = F.col("pos") - fold_start(splits)
    return F.greatest(F.floor(offset / F.col("horizon")), F.lit(-1)).cast("int")
