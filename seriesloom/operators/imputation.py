"""Iterative imputation with random forests, as rounds of distributed fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null, numeric_columns
from ..session import materialise
from .quantiles import exact_quantiles
from .profile import unpivot_numeric


@dataclass(frozen=True)
class ForestSettings:
    """Sizes of the imputation forests; the fixed defaults suit a nightly job."""

    num_trees: int = 600
    max_depth: int = 12
    target_depth: int = 14
    min_leaf: int = 2
    max_iter: int = 10
    tolerance: float = 1e-3
    store_every: int = 4
    seed: int = 0


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of a few named columns."""
    long = unpivot_numeric(df, columns)
    found = exact_quantiles(long, keys=["column_name"], value="value", qs=[0.5], few_keys=True)
    return {r["column_name"]: r["quantile"] for r in found.collect()}


def _forest(features: Sequence[str], label: str, depth: int, seed: int, s: ForestSettings):
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip")
    forest = RandomForestRegressor(
        featuresCol="__x", labelCol=label, predictionCol="__p", numTrees=s.num_trees, maxDepth=depth,
        minInstancesPerNode=s.min_leaf, featureSubsetStrategy="sqrt", seed=seed,
    )
    return assembler, forest


def _refit(df: DataFrame, column: str, features, missing: str, depth: int, seed: int, s) -> DataFrame:
    """Predict ``column`` where ``missing`` from the other features."""
    assembler, forest = _forest(features, column, depth, seed, s)
    ready = assembler.transform(df)
    model = forest.fit(ready.where(~F.col(missing)).select("__x", F.col(column).cast("double")))
    # Only rows that need a prediction go through the forest.
    filled = model.transform(ready.where(missing)).withColumn(column, F.col("__p")).drop("__x", "__p")
    return ready.where(~F.col(missing)).drop("__x").unionByName(filled.select(*df.columns))


def impute_forest(
    df: DataFrame,
    target: str,
    *,
    columns: Sequence[str] | None = None,
    settings: ForestSettings = ForestSettings(),
) -> DataFrame:
    """Fill the numeric columns from each other, then the target from them.

    Columns start at their medians; a round refits every incomplete column on the
    others, the least incomplete first. The table is stored after every
    ``store_every`` columns, so a fit recomputes at most that many earlier
    predictions and plans do not grow. Rounds end early once no imputed value
    moves by more than ``tolerance`` times the largest value.
    """
    s = settings
    df = nan_to_null(df)
    names = [c for c in (columns or numeric_columns(df)) if c != target]
    missing = [F.count_if(F.col(c).isNull()).alias(c) for c in [*names, target]]
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *missing).first()
    names = [c for c in names if counts[c] < counts["__rows"]]  # a column without any value cannot help
    holes = sorted((c for c in names if counts[c] > 0), key=lambda c: counts[c])
    marks = {f"__null_{c}": F.col(c).isNull() for c in [*holes, target]}
    out = df.withColumns(marks)
    if holes:
        start = medians(df, holes)
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(start[c])) for c in holes})
        out = materialise(out)
        for turn in range(s.max_iter if len(names) > 1 else 0):
            before = {f"__was_{c}": F.col(c) for c in holes}
            step = out.withColumns(before)
            for at, c in enumerate(holes, start=1):
                others = [x for x in names if x != c]
                step = _refit(step, c, others, f"__null_{c}", s.max_depth, s.seed + turn, s)
                if at % s.store_every == 0 or at == len(holes):
                    step = materialise(step)
            moved = step.agg(
                F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(c) - F.col(f"__was_{c}"))) for c in holes]).alias("d"),
                F.greatest(F.lit(0.0), *[F.max(F.abs(c)) for c in holes]).alias("m"),
            ).first()
            out = step.drop(*before)
            if moved["d"] <= s.tolerance * moved["m"]:
                break
    if counts[target] > 0 and names:
        out = _refit(out, target, names, f"__null_{target}", s.target_depth, s.seed + 1, s)
    return out.drop(*marks)
