"""Places of rows in a total order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def with_ordinals(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with ``at`` (place in their group, from 0) and ``n`` (rows of the group).

    One range shuffle sorts the rows by group and order, nulls first; a hot group covers
    as many ranges as it needs. A row's place is its number in its range plus the sizes of
    the group's earlier ranges, a table with at most a row per range and group. The sorted
    rows are stored before they are numbered, so a lost task cannot renumber them. Rows
    that are equal in ``order`` are numbered in any way.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = materialise(ranged.withColumn("__row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__row", 33))
    ranges = ranged.groupBy(group, "__range").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__size"))
    whole = Window.partitionBy("__group")
    earlier = whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col(group).alias("__group"), F.col("__range").alias("__r"), "__first", "__size").select(
        "__group", "__r", (F.coalesce(F.sum("__size").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__size").over(whole).alias("n"),
    )
    same = (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__group"))
    placed = ranged.join(offsets, same).withColumn("at", F.col("__row") + F.col("__shift"))
    return placed.drop("__row", "__range", "__group", "__r", "__shift")
