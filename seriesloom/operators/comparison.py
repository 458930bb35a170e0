"""Diebold–Mariano tests of all model pairs with Newey–West variances.

The losses of a timestamp stay together in one wide row, so no pair is ever shuffled.
With Bartlett weights the long-run variance is the mean square of all sums of
``lags + 1`` neighbours, rows outside the series counting as zero. Such a sum is the
difference of two running sums, and the one of a pair of models is the difference of the
models' own. So a row needs one other row however many lags there are, and only the sums
of squares of the pairs leave the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import (
    newey_west_lags,
    normal_two_sided,
    significance_stars,
    student_two_sided,
)
from ..functions.time import HOUR
from ..session import materialise
from .chunks import CHUNK_ROWS, running_sums
from .positions import with_positions

LOSSES = ("MAE", "MSE")
MIN_ROWS = 5


def wide_predictions(
    predictions: DataFrame,
    models: Sequence[str],
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """One row per series and timestamp: ``y`` and one column per model.

    Several forecasts of a model for one timestamp (of more than one horizon, say) are
    an error; put what tells them apart into ``series``.
    """
    clash = F.raise_error(F.lit("several forecasts of a model for one timestamp")).cast("double")

    def only(m: str):
        mine = F.col("model") == m
        return F.when(F.count_if(mine) > 1, clash).otherwise(F.max(F.when(mine, F.col("yhat"))))

    picked = [only(m).alias(m) for m in models]
    return predictions.groupBy(*series, ts).agg(F.max("y").alias("y"), *picked)


def _loss(y: str, model: str, loss: str):
    e = F.col(y) - F.col(model)
    return F.abs(e) if loss == "MAE" else e * e


def _lags(n: Column, h: int, lags: int | None, auto_lags: bool) -> Column:
    """Lags of the long-run variance: given, by the rule on the sample size, or h - 1."""
    if lags is not None:
        return F.lit(max(0, lags))
    return newey_west_lags(n) if auto_lags else F.lit(max(0, h - 1))


def diebold_mariano(
    wide: DataFrame,
    models: Sequence[str],
    *,
    y: str = "y",
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = HOUR,
    h: int = 1,
    lags: int | None = None,
    auto_lags: bool = True,
    corrected: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A row per series, pair (in the order of ``models``) and loss.

    The variance covers floor(4 (n/100)^(2/9)) lags, ``lags`` if given, or h - 1 without
    ``auto_lags``. ``corrected`` applies the small-sample factor; without it the statistic
    is the raw one and has no Student p-value. Rows without a target are left out; a NULL
    forecast or a variance that is not positive gives a NULL row with ``better = 'NA'``.
    Series of fewer than five rows have no tests; fewer than two models are an error.
    """
    if len(models) < 2:
        raise ValueError("pairwise tests need two models")
    keys = list(series)
    cells = [(m, loss) for loss in LOSSES for m in models]
    place = {cell: i for i, cell in enumerate(cells)}
    sums = {f"__s{i}": _loss(y, m, loss) for i, (m, loss) in enumerate(cells)}
    sums |= {f"__k{j}": F.col(m).isNotNull().cast("long") for j, m in enumerate(models)}
    rows = with_positions(
        wide.where(F.col(y).isNotNull()).select(*keys, ts, y, *models),
        series=keys, ts=ts, step_seconds=step_seconds, bucket_rows=chunk_rows, sums=sums,
    ).where(F.col("n") >= MIN_ROWS)
    deviations = [f"__d{i}" for i in range(len(cells))]
    rows = rows.select(
        *keys, "pos", "n", _lags(F.col("n"), h, lags, auto_lags).alias("__lags"),
        F.when(F.col("pos") == 0, F.struct(*sums)).alias("__of_series"),
        *[(_loss(y, m, loss) - F.col(f"__s{i}") / F.col("n")).alias(f"__d{i}") for i, (m, loss) in enumerate(cells)],
    )
    rows = running_sums(rows, deviations, series=keys, chunk_rows=chunk_rows)
    sizes = F.array(*deviations).alias("__sum")
    rows = materialise(rows.select(*keys, "pos", "n", "__lags", "__of_series", sizes))  # joined with itself
    reach = F.col("__lags") + 1
    past = rows.select(*keys, (F.col("pos") + reach).alias("pos"), F.col("__sum").alias("__past"))
    joined = rows.join(past, [*keys, "pos"], "left")
    # The sums that run out of the series at its end; the last running sum is zero.
    runs_out = (F.col("pos") >= F.col("n") - reach) & (F.col("pos") < F.col("n") - 1)
    pairs = [(a, b, loss) for a, b in combinations(models, 2) for loss in LOSSES]

    def term(a, b, loss):
        i, j = place[a, loss], place[b, loss]
        now = F.col("__sum")[i] - F.col("__sum")[j]
        gap = now - F.coalesce(F.col("__past")[i] - F.col("__past")[j], F.lit(0.0))
        return gap * gap + F.when(runs_out, now * now).otherwise(0.0)

    totals = joined.groupBy(*keys).agg(
        F.any_value("n").alias("n"),
        F.any_value("__lags").alias("__lags"),
        F.any_value("__of_series", True).alias("__of_series"),
        *[F.sum(term(*p)).alias(f"__t{i}") for i, p in enumerate(pairs)],
    )
    totals = totals.select(*keys, "n", "__lags", "__of_series.*", *[f"__t{i}" for i in range(len(pairs))])
    entries = [
        F.struct(
            F.lit(f"{a} vs {b}").alias("pair"),
            F.lit(loss).alias("loss"),
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            ((F.col(f"__s{place[a, loss]}") - F.col(f"__s{place[b, loss]}")) / F.col("n")).alias("mean"),
            (F.col(f"__t{i}") / reach / F.col("n") / F.col("n")).alias("var"),
            (
                (F.col(f"__k{models.index(a)}") == F.col("n"))
                & (F.col(f"__k{models.index(b)}") == F.col("n"))
            ).alias("full"),
        )
        for i, (a, b, loss) in enumerate(pairs)
    ]
    flat = totals.select(*keys, "n", "__lags", F.explode(F.array(*entries)).alias("p"))
    n, usable = F.col("n"), F.col("p.full") & (F.col("p.var") > 0)
    raw = F.col("p.mean") / F.sqrt("p.var")
    kappa = F.sqrt((n + 1 - 2 * h + F.lit(h * (h - 1)) / n) / n) if corrected else F.lit(1.0)
    out = flat.select(
        *series,
        F.col("p.pair").alias("pair"),
        F.col("p.loss").alias("loss"),
        F.when(usable, n).alias("n"),
        F.lit(h).alias("h"),
        F.when(usable, F.col("__lags")).alias("nw_lags"),
        F.when(usable, raw).alias("dm_raw"),
        F.when(usable, raw * kappa).alias("dm"),
        F.when(usable, F.col("p.mean")).alias("mean_diff"),
        F.when(~usable, F.lit("NA"))
        .when(F.col("p.mean") < 0, F.col("p.a"))
        .otherwise(F.col("p.b"))
        .alias("better"),
    )
    student = student_two_sided("dm", F.col("n") - 1) if corrected else F.lit(None).cast("double")
    return out.withColumns({"p_norm": normal_two_sided("dm"), "p_t": student})


def dm_summary(tests: DataFrame, *, series: Sequence[str] = ("series_id",)) -> DataFrame:
    """Compact table with significance marks."""
    return tests.select(
        *series, "pair", "loss", "better", "mean_diff", "dm", "p_t",
        significance_stars("p_t").alias("sig"), "n", "nw_lags",
    )


def sorted_summary(summary: DataFrame, *, series: Sequence[str] = ("series_id",)) -> DataFrame:
    """Sink order: smallest p-value first, then the larger difference."""
    return summary.orderBy(
        *series, F.col("p_t").asc_nulls_last(), F.abs("mean_diff").desc_nulls_last(), "pair", "loss"
    )
