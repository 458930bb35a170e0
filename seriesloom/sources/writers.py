"""Writers: complete Parquet tables, forecast CSVs, JSON fold summaries.

Output folders are Spark folders; the committer makes a write appear whole or not at
all. Tables refuse a name that is taken, reports go to a second one.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BOM
from ..functions.time import as_column
from .files import move_to_free_name

DECIMALS = 6
log = logging.getLogger(__name__)


def iso_time(c) -> Column:
    return F.date_format(as_column(c), "yyyy-MM-dd'T'HH:mm:ss")


def write_complete(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> int:
    """Write the rows without NULLs as Parquet; returns how many rows were dropped.

    The count comes from an observation of the write itself, not a second scan.
    """
    from pyspark.sql import Observation

    seen = Observation()
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    watched = df.withColumn("__complete", complete).observe(
        seen, F.count_if(~F.col("__complete")).alias("dropped")
    )
    out = watched.where("__complete").drop("__complete").write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return seen.get["dropped"]


def write_forecasts(
    wide: DataFrame,
    path: str,
    *,
    ts: str = "ts",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """CSV with a ``timestamp`` column first and six decimals; NULL stays empty."""
    rest = [c for c in wide.columns if c != ts]
    named = wide.select(F.col(ts).alias("timestamp"), *rest)
    floats = [f.name for f in named.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    shown = named.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{DECIMALS}f", F.col(c))) for c in floats}
    ).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    out = shown.sortWithinPartitions("timestamp").write.mode(mode).option("header", True)
    (out.partitionBy(*partition_by) if partition_by else out).csv(path)


def write_table(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """CSV of any size; an ordered input gives part files in that order."""
    df.write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, *, bom: bool = False) -> str:
    """Report as CSV, ordered part files if the input is ordered; returns where it is.

    With ``bom`` the first header carries a byte order mark. The report is written beside
    its target and renamed when it is whole. An older report is neither overwritten nor
    mixed with: if the name is taken, the new one gets the time as a suffix.
    """
    shown = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    folder, _, name = path.rstrip("/").rpartition("/")
    staged = f"{folder}/.{name}-{uuid.uuid4().hex}"
    shown.write.option("header", True).csv(staged)
    written = move_to_free_name(df.sparkSession, staged, path)
    if written != path.rstrip("/"):
        log.warning("%s is taken, the report is %s", path, written)
    return written


def write_summary(summary: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Fold summaries (means plus arrays per fold) as JSON lines."""
    summary.write.mode(mode).json(path)
