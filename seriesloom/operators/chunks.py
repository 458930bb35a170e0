"""Window functions over long series, run per chunk with overlapping edges.

Rows are assigned to chunks of ``chunk_rows`` positions. Each row is also sent to
the neighbouring chunks whose frames reach it (the overlap is ``before`` plus
``after`` rows per chunk), windows run per (series, chunk), and the visiting rows
are dropped. For bounded row frames the result equals the window over the whole
series, but one series spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.time import floor_div

CHUNK_ROWS = 4096

Builder = Callable[[WindowSpec], dict[str, Column]]


def spread_chunks(
    df: DataFrame, *, before: int, after: int = 0, pos: str = "pos", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Copy edge rows to neighbouring chunks; adds ``__chunk`` and ``__home``."""
    p = F.col(pos)
    first = floor_div(F.greatest(p - after, F.lit(0)), chunk_rows)
    last = floor_div(p + before, chunk_rows)
    if "n" in df.columns:
        last = F.least(last, floor_div(F.col("n") - 1, chunk_rows))
    return (
        df.withColumn("__chunk", F.explode(F.sequence(first, last)))
        .withColumn("__home", F.col("__chunk") == floor_div(p, chunk_rows))
    )


def over_chunks(
    df: DataFrame,
    *builds: Builder,
    series: Sequence[str] = ("series_id",),
    before: int,
    after: int = 0,
    pos: str = "pos",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns. Later builders may use the columns of earlier ones.

    All builders get the same window specification, so one shuffle and one sort
    serve every column.
    """
    size = max(chunk_rows, before, after)
    out = spread_chunks(df, before=before, after=after, pos=pos, chunk_rows=size)
    w = Window.partitionBy(*series, "__chunk").orderBy(pos)
    for build in builds:
        out = out.withColumns(build(w))
    return out.where("__home").drop("__chunk", "__home")


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    *,
    series: Sequence[str] = ("series_id",),
    pos: str = "pos",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Replace NULL by the last earlier value of the series.

    The frame is unbounded, so an overlap does not do: each chunk fills itself,
    and the last value of every earlier chunk is carried in from a table with one
    row per chunk.
    """
    keys = list(series)
    cut = df.withColumn("__chunk", floor_div(F.col(pos), chunk_rows))
    running = (
        Window.partitionBy(*keys, "__chunk")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last_of_chunk = cut.groupBy(*keys, "__chunk").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"__last_{i}")
            for i, c in enumerate(columns)
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_chunk.select(
        *keys,
        "__chunk",
        *[
            F.last(f"__last_{i}", ignorenulls=True).over(earlier).alias(f"__carry_{i}")
            for i in range(len(columns))
        ],
    )
    filled = cut.withColumns({c: F.last(c, ignorenulls=True).over(running) for c in columns})
    joined = filled.join(carried, [*keys, "__chunk"])
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"__carry_{i}")) for i, c in enumerate(columns)}
    ).drop("__chunk", *[f"__carry_{i}" for i in range(len(columns))])


def running_sums(
    df: DataFrame,
    columns: Sequence[str],
    *,
    series: Sequence[str] = ("series_id",),
    pos: str = "pos",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Replace each column by its sum over the series up to the row (NULL counts as zero).

    Sums run inside chunks; the sums of all earlier chunks come from a table with a row
    per chunk.
    """
    keys, number = list(series), range(len(columns))
    cut = df.withColumn("__chunk", floor_div(F.col(pos), chunk_rows))
    values = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "__chunk")
        .agg(*[F.sum(v).alias(f"__total_{i}") for i, v in enumerate(values)])
        .select(
            *keys, "__chunk",
            *[F.coalesce(F.sum(f"__total_{i}").over(before), F.lit(0.0)).alias(f"__offset_{i}") for i in number],
        )
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(pos)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({c: F.sum(v).over(upto) for c, v in zip(columns, values, strict=True)})
    return (
        local.join(offsets, [*keys, "__chunk"])
        .withColumns({c: F.col(c) + F.col(f"__offset_{i}") for i, c in enumerate(columns)})
        .drop("__chunk", *[f"__offset_{i}" for i in number])
    )
