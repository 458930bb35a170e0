"""Permutation importance: how much the error grows when one feature is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.permute import round_keys, shuffled_place
from ..session import materialise
from .forecasters import Fitted, Forecaster

# Window, repeats and list length of an importance report.
WINDOW_ROWS = 168
MIN_WINDOW = 24
REPEATS = 10
TOP = 20


def with_donors(
    valid: DataFrame, features: Sequence[str], repeats: int, seed: int = 42, size: str = "size"
) -> DataFrame:
    """The rows with ``__donors``: for each repeat the features of the row that a permutation sends here.

    ``valid`` has a ``place`` (0-based, without gaps) in a series and its ``size``. All
    features of a repeat follow one permutation, a keyed bijection of places, so nothing
    is sorted and a row is sent once per repeat however many features there are.
    """
    trials = [
        F.struct(F.lit(r).alias("repeat"), shuffled_place(F.col("place"), F.col(size), round_keys(seed, r)).alias("to"))
        for r in range(1, repeats + 1)
    ]
    values = F.array(*[F.col(f).cast("double") for f in features])
    sent = valid.select("series_id", F.explode(F.array(*trials)).alias("t"), values.alias("values")).select(
        "series_id", F.col("t.to").alias("place"), F.struct("t.repeat", "values").alias("donor")
    )
    # A place gets one donor per repeat.
    donors = sent.groupBy("series_id", "place").agg(F.collect_list("donor").alias("__donors"))
    return valid.join(donors, ["series_id", "place"])


def _trials(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every row once per repeat and feature, with that feature's value from the donor."""
    names = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("i")) for i, f in enumerate(features)])
    one = rows.withColumn("__d", F.explode("__donors")).withColumn("__f", F.explode(names))
    value = F.col("__d.values")[F.col("__f.i")]
    swapped = {
        f: F.when(F.col("__f.i") == i, value).otherwise(F.col(f).cast("double")) for i, f in enumerate(features)
    }
    named = {"feature": F.col("__f.feature"), "repeat": F.col("__d.repeat")}
    return one.withColumns(swapped | named).drop("__d", "__f", "__donors")


def _error_growth(scored: DataFrame, base: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    mae = F.avg(F.abs(F.col(target) - F.col("yhat")))
    after = scored.groupBy(*by, "feature", "repeat").agg(mae.alias("__mae"))
    mean = after.groupBy(*by, "feature").agg(F.avg("__mae").alias("__mean"))
    if by:
        before = base.groupBy(*by).agg(mae.alias("__base"))
        joined = mean.join(before, list(by))
    else:
        joined = mean.withColumn("__base", base.agg(mae).scalar())
    return joined.select(*by, "feature", (F.col("__mean") - F.col("__base")).alias("importance"))


def permutation_importance(
    positioned: DataFrame,
    model: Forecaster,
    target: str,
    features: Sequence[str],
    *,
    window: int | None = WINDOW_ROWS,
    repeats: int = REPEATS,
    seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """``feature, importance`` as the mean growth of the absolute error.

    The model is fitted on the rows before the last ``window`` rows of each series
    (at least 24) and scored on those; ``window=None`` fits and scores on all rows.
    ``by=['series_id']`` reports per series instead of pooled.
    """
    rows = materialise(positioned)
    if window is None:
        train = rows
        valid = rows.withColumns({"place": F.col("pos"), "size": F.col("n")})
    else:
        size = F.least(F.lit(max(window, MIN_WINDOW)), F.greatest(F.lit(MIN_WINDOW), F.col("n") - 1))
        first = F.greatest(F.col("n") - size, F.lit(0))
        train = rows.where(F.col("pos") < first)
        valid = rows.where(F.col("pos") >= first)
        valid = valid.withColumns({"place": F.col("pos") - first, "size": F.col("n") - first})
    fitted = model.fit(train, target, features)
    return shuffle_and_score(fitted, valid, target, features, repeats=repeats, seed=seed, by=by)


def shuffle_and_score(
    fitted: Fitted,
    valid: DataFrame,
    target: str,
    features: Sequence[str],
    *,
    repeats: int,
    seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """Importance of a fitted model on rows with a ``place`` (0-based per series) and ``size``.

    The rows of a trial form a series of their own for models that read a row's past.
    """
    trials = _trials(with_donors(valid, features, repeats, seed), features)
    scored = fitted.predict(trials, series=["series_id", "feature", "repeat"])
    return _error_growth(scored, fitted.predict(valid), target, by)


def window_importance(
    fitted: Fitted,
    positioned: DataFrame,
    target: str,
    features: Sequence[str],
    *,
    context: int,
    window: int = WINDOW_ROWS,
    repeats: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Importance of an already fitted lookback model.

    Only the last ``window`` rows are shuffled; the ``context`` rows before them
    stay as they are and are repeated for every trial. Rows of a trial form their
    own series for the model's windows.
    """
    start = F.col("n") - window
    rows = positioned.where((F.col("n") > window) & (F.col("pos") >= start - context))
    rows = materialise(rows)
    valid = rows.where(F.col("pos") >= start).withColumns({"place": F.col("pos") - start, "size": F.lit(window)})
    tested = _trials(with_donors(valid, features, repeats, seed), features)
    names = F.array(*[F.lit(f) for f in features])
    idle = rows.where(F.col("pos") < start).withColumn("feature", F.explode(names)).withColumn(
        "repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    )
    every = tested.drop("place", "size").unionByName(idle)
    scored = fitted.predict(every, series=["series_id", "feature", "repeat"])
    base = fitted.predict(rows)
    keep = F.col("pos") >= F.col("n") - window
    return _error_growth(scored.where(keep), base.where(keep), target, [])


def top_importance(importance: DataFrame, top: int = TOP, by: Sequence[str] = ()) -> DataFrame:
    """The ``top`` features by importance; names settle ties."""
    order = [F.col("importance").desc(), F.col("feature").asc()]
    if not by:
        return importance.orderBy(*order).limit(top)
    w = Window.partitionBy(*by).orderBy(*order)
    return importance.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top)
