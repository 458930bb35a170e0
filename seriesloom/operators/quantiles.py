"""Exact linear-interpolated quantiles by distributed selection, without gathering a group's values.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. Here
each wanted quantile has a bracket of values that holds its two order statistics, at
first the whole range. The values in the bracket are counted in equal bins (with map-side
combine), and the least and greatest value of the bins that hold the order statistics
are the next bracket. It narrows until few values are left, which are then counted one
by one. Counts are exact in every round, so a bracket never misses its rank, and no task
sees more than the bins or the last few values of a quantile, however hot a key is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .positions import attach_balanced

BINS = 1024
FEW_VALUES = 1 << 16
ROWS_PER_SALT = 1 << 20
LARGEST = 1.7976931348623157e308


def finite(value) -> Column:
    """``value`` as a double, NULL for NaN, infinities as the largest doubles."""
    v = F.col(value).cast("double") if isinstance(value, str) else value
    # Bounds are taken of known values only: they would stand for a missing one.
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST)))


def _in_brackets(values: DataFrame, state: DataFrame, keys: list[str], few_keys: bool) -> DataFrame:
    """Rows (keys, b, __v): each value once for every bracket of its key that it lies in."""
    entry = F.struct("i", "low", "high", "below", "first", "second")
    per_key = state.groupBy(*keys).agg(F.collect_list(entry).alias("__brackets"), F.max("n").alias("__n"))
    if few_keys:
        joined = values.join(F.broadcast(per_key.drop("__n")), keys)
    else:
        # Hot keys are spread by value, over as many tasks as the largest needs.
        most = per_key.agg(F.max("__n")).first()[0] or 1
        salt = F.pmod(F.xxhash64("__v"), F.lit(math.ceil(most / ROWS_PER_SALT)))
        joined = attach_balanced(values, per_key.drop("__n"), keys=keys, bucket=salt)
    v = F.col("__v")
    mine = F.filter("__brackets", lambda b: (v >= b["low"]) & (v <= b["high"]))
    return joined.select(*keys, "__v", F.explode(mine).alias("b"))


def _bin(bins: int) -> Column:
    """Bin of a value in its bracket; halves, so that no difference overflows."""
    v, low, high = F.col("__v") / 2, F.col("b.low") / 2, F.col("b.high") / 2
    return F.least(F.floor(F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0)) * bins), F.lit(bins - 1))


def _narrowed(inside: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The brackets after a round of counting; with both order statistics if bins tell them apart."""
    quantile = [*keys, "i", "first", "second"]
    counted = (
        inside.groupBy(*keys, "b.i", "b.first", "b.second", "b.below", _bin(bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    )
    order = Window.partitionBy(*keys, "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.withColumn("upto", F.col("below") + F.sum("c").over(order))
    before = F.col("upto") - F.col("c")
    has_first = (before <= F.col("first")) & (F.col("first") < F.col("upto"))
    has_second = (before <= F.col("second")) & (F.col("second") < F.col("upto"))
    return running.groupBy(*quantile).agg(
        F.max(F.when(has_first, F.col("least"))).alias("low"),
        F.max(F.when(has_second, F.col("most"))).alias("high"),
        F.max(F.when(has_first, before)).alias("below"),
        F.sum(F.when(has_first | has_second, F.col("c"))).alias("inside"),
        F.max(F.when(has_first & ~has_second, F.col("most"))).alias("a"),
        F.max(F.when(has_second & ~has_first, F.col("least"))).alias("b"),
    )


def exact_quantiles(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    qs: Sequence[float],
    few_keys: bool = False,
    extent: DataFrame | None = None,
    bins: int = BINS,
    few_values: int = FEW_VALUES,
) -> DataFrame:
    """Rows ``keys…, q, n, quantile``.

    NULL and NaN are left out, infinities count as the largest doubles. ``few_keys`` states
    that the number of keys is bounded by the code (column names, say), so the brackets may
    be broadcast. Otherwise the join is salted by value, so a hot key spreads over many
    tasks. ``extent`` (keys, n, low, high) saves the pass that counts the values of ``finite``.
    """
    keys, qs = list(keys), sorted(float(q) for q in qs)
    values = df.select(*keys, finite(value).alias("__v")).where("__v IS NOT NULL")
    if extent is None:
        extent = values.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")
        )
    number = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q")) for i, q in enumerate(qs)])
    ranks = extent.select(*keys, "n", "low", "high", F.explode(number).alias("w")).withColumn(
        "r", (F.col("n") - 1) * F.col("w.q")
    )
    state = materialise(
        ranks.where("n > 0").select(
            *keys, "w.i", "n", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"),
            F.floor("r").alias("first"), F.ceil("r").alias("second"),
            F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"),
        )
    )
    # Brackets that halves cannot tell apart hold two values at most.
    wide = F.col("a").isNull() & (F.col("inside") > few_values) & (F.col("high") / 2 > F.col("low") / 2)
    while not state.where(wide).isEmpty():
        again = _narrowed(_in_brackets(values, state.where(wide), keys, few_keys), keys, bins)
        sizes = state.where(wide).select(*keys, "i", "n")
        state = materialise(state.where(~wide).unionByName(again.join(sizes, [*keys, "i"])))
    inside = _in_brackets(values, state.where("a IS NULL"), keys, few_keys)
    counted = inside.groupBy(*keys, "b.i", "b.first", "b.second", "b.below", "__v").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys, "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.withColumn("upto", F.col("below") + F.sum("c").over(order))

    def order_statistic(rank: str) -> Column:
        holds = (F.col("upto") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
        return F.max(F.when(holds, F.col("__v")))

    last = running.groupBy(*keys, "i").agg(order_statistic("first").alias("a"), order_statistic("second").alias("b"))
    told_apart = state.where("a IS NOT NULL").select(*keys, "i", "a", "b")
    found = last.unionByName(told_apart).join(state.select(*keys, "i", "n"), [*keys, "i"])
    q = F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("i") + 1)
    r = (F.col("n") - 1) * q
    return found.select(
        *keys, q.alias("q"), "n", (F.col("a") + (F.col("b") - F.col("a")) * (r - F.floor(r))).alias("quantile")
    )
