"""KPSS and augmented Dickey–Fuller tests per series, as distributed sums.

Neither test gathers a series: KPSS needs a few lag products and partial sums,
which chunked windows give, and the Dickey–Fuller regression needs only cross products
of lagged values. These depend on the distance of the lags but for the ends of a series,
so a chunk adds up two numbers for each lag, and one factorisation of the matrix that
they make gives the fits of all lag orders.

KPSS lag choice follows Hobijn, Franses and Ooms (1998); its p-value interpolates
the table of Kwiatkowski et al. (1992). The Dickey–Fuller p-value uses the response
surface of MacKinnon (1994).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..functions.time import HOUR, floor_div
from ..session import materialise
from .chunks import CHUNK_ROWS, over_chunks, spread_chunks
from .positions import with_positions

MIN_ROWS = 100

# KPSS critical values (level case) and their p-values.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)

# MacKinnon response surface, constant, one variable.
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def _lag_products(
    df: DataFrame,
    weights: dict[str, Callable[[Column], Column]],
    upto: Column,
    max_lag: int,
    series: Sequence[str],
    chunk_rows: int,
) -> DataFrame:
    """Add one column per weight: the sum over k = 1..upto of weight(k) times the value k rows back."""
    max_lag = max(1, max_lag)

    def gather(w):
        return {"__past": F.collect_list("__e").over(w.rowsBetween(-max_lag, -1))}

    rows = over_chunks(df, gather, series=series, before=max_lag, chunk_rows=chunk_rows)
    size = F.size("__past")
    reach = F.least(upto, size)
    recent = F.slice("__past", size - reach + 1, reach)

    def total(weight):
        parts = F.transform(recent, lambda x, i: x * weight((reach - i).cast("double")))
        return F.when(reach > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)

    return rows.withColumns({name: total(weight) for name, weight in weights.items()}).drop("__past")


def kpss(
    df: DataFrame,
    column: str,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = HOUR,
    least: int = MIN_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``n, lags, kpss, kpss_p`` of the level-stationarity test, series of ``least`` rows or more.

    One number reaches the driver: the longest series, which bounds a window frame.
    """
    keys = list(series)
    complete = df.select(*keys, ts, F.col(column).alias("__y")).where("__y IS NOT NULL")
    rows = with_positions(
        complete, series=keys, ts=ts, step_seconds=step_seconds, bucket_rows=chunk_rows,
        sums={"__sum": F.col("__y")},
    ).where(F.col("n") >= least)
    rows = rows.withColumn("__e", F.col("__y") - F.col("__sum") / F.col("n")).drop("__y", "__sum")
    rows = materialise(rows)  # read by both stages below
    longest = rows.agg(F.max("n")).first()[0] or 1
    cover = F.floor(F.pow(F.col("n").cast("double"), F.lit(2.0 / 9.0))).cast("int")
    cover_max = int(longest ** (2.0 / 9.0)) + 1
    ramped = _lag_products(
        rows, {"__l0": lambda k: F.lit(1.0), "__l1": lambda k: k}, cover, cover_max, keys, chunk_rows
    )
    stage = ramped.groupBy(*keys).agg(
        F.any_value("n").alias("n"),
        F.sum(F.col("__e") * F.col("__e")).alias("__g0"),
        F.sum(F.col("__e") * F.col("__l0")).alias("__g1"),
        F.sum(F.col("__e") * F.col("__l1")).alias("__g2"),
    )
    n = F.col("n").cast("double")
    s0 = F.col("__g0") / n + F.col("__g1") * 2 / n
    s1 = F.col("__g2") * 2 / n
    ratio = s1 / F.nullif(s0, F.lit(0.0))  # NULL for a constant series
    width = F.lit(1.1447) * F.pow(ratio * ratio, F.lit(1.0 / 3.0))
    lags = F.least(F.floor(width * F.pow(n, F.lit(1.0 / 3.0))), F.col("n") - 1).cast("int")
    chosen = stage.select(*keys, lags.alias("lags"))
    sums = _partial_sums(rows, chosen, keys, chunk_rows)
    # With Bartlett weights the long-run variance is the mean square of all sums of
    # lags + 1 neighbours (rows outside the series count as zero), so differences of
    # partial sums replace the lag products. The last partial sum is zero.
    reach = F.col("lags") + 1
    past = sums.select(*keys, (F.col("pos") + reach).alias("pos"), F.col("__s").alias("__past"))
    joined = sums.join(past, [*keys, "pos"], "left")
    gap = F.col("__s") - F.coalesce("__past", F.lit(0.0))
    runs_out = (F.col("pos") >= F.col("n") - reach) & (F.col("pos") < F.col("n") - 1)
    square = F.col("__s") * F.col("__s")
    totals = joined.groupBy(*keys).agg(
        F.any_value("n").alias("n"),
        F.any_value("lags").alias("lags"),
        F.sum(square).alias("__eta"),
        F.sum(gap * gap + F.when(runs_out, square).otherwise(0.0)).alias("__runs"),
    )
    stat = F.col("__eta") / (n * n) / (F.nullif("__runs", F.lit(0.0)) / reach / n)
    return totals.select(*keys, "n", "lags", stat.alias("kpss"), kpss_p_value(stat).alias("kpss_p"))


def _partial_sums(rows: DataFrame, chosen: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """``pos, n, lags, __s`` with the running sum of ``__e``; stored, as it is read twice.

    Sums run inside chunks; the sum of all earlier chunks comes from a table with a
    row per chunk, which also brings the lags of the series.
    """
    cut = rows.withColumn("__chunk", floor_div(F.col("pos"), chunk_rows))
    inside = Window.partitionBy(*keys, "__chunk").orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "__chunk")
        .agg(F.sum("__e").alias("__total"))
        .withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0.0)))
        .join(chosen, keys)
        .select(*keys, "__chunk", "__offset", "lags")
    )
    local = cut.withColumn("__c", F.sum("__e").over(upto))
    total = local.join(offsets, [*keys, "__chunk"]).withColumn("__s", F.col("__c") + F.col("__offset"))
    return materialise(total.select(*keys, "pos", "n", "lags", "__s"))


def kpss_p_value(stat: Column) -> Column:
    """Linear interpolation in the published table, clamped to its ends."""
    out = F.lit(KPSS_P[-1])
    for i in reversed(range(len(KPSS_P) - 1)):
        x0, x1, p0, p1 = KPSS_CRITICAL[i], KPSS_CRITICAL[i + 1], KPSS_P[i], KPSS_P[i + 1]
        line = p0 + (stat - x0) * ((p1 - p0) / (x1 - x0))
        out = F.when(stat < x1, line).otherwise(out)
    return F.when(stat <= KPSS_CRITICAL[0], F.lit(KPSS_P[0])).otherwise(out)


def adf_max_lag(n: int) -> int:
    """ceil(12 (n/100)^(1/4)), kept below half the sample."""
    return max(0, min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2))


def _lags_of(n: int, lags: int | None) -> int:
    return adf_max_lag(n) if lags is None else max(0, min(lags, n // 2 - 2))


def _lag_sums(pdf: pd.DataFrame, series: list[str], lags: int | None) -> pd.DataFrame:
    """Sums over one chunk: (i, v) with 2 (p + 1) + 2 numbers for p lags.

    In order: the differences times those k steps back (k = 0..p, wherever both exist),
    the level times the difference j steps before the target (j = 0..p), the level and its
    square; the latter three over the rows that have p lags. ``pdf`` holds a chunk and the
    rows before it that its lags reach.
    """
    pdf = pdf.sort_values("pos")
    y, pos, home = pdf["y"].to_numpy(float), pdf["pos"].to_numpy(), pdf["home"].to_numpy()
    p = _lags_of(int(pdf["n"].iloc[0]), lags)
    change = np.diff(y, prepend=np.nan)
    at, full = np.flatnonzero(home & (pos >= 1)), np.flatnonzero(home & (pos >= p + 1))
    level = y[full - 1]
    banded = [change[back] @ change[back - k] for k in range(p + 1) for back in [at[pos[at] - k >= 1]]]
    sums = [*banded, *[level @ change[full - j] for j in range(p + 1)], level.sum(), level @ level]
    out = pd.DataFrame({"i": np.arange(len(sums)), "v": sums})
    for s in series:
        out.insert(0, s, pdf[s].iloc[0])
    return out


def _gram(n: int, p: int, sums: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Cross products of [1, level, differences 1..p steps before, difference] over the rows with p lags.

    A product of two differences depends on their distance only, but for the ends of the
    series: those are taken off with the first and last values. Sums of differences telescope.
    """
    gram = np.zeros((p + 3, p + 3))
    rows = n - 1 - p
    gram[0, 0], gram[0, 1], gram[1, 1] = rows, sums[-2], sums[-1]
    place = [p + 2, *range(2, p + 2)]  # of the difference j steps before the target
    early, late = np.diff(head), np.diff(tail)[::-1]  # differences 1, 2, … and n - 1, n - 2, …
    for j in range(p + 1):
        gram[0, place[j]] = tail[len(tail) - 1 - j] - head[p - j]
        gram[1, place[j]] = sums[p + 1 + j]
    for k in range(p + 1):
        # Products of distance k: the first ones in the order of time, the last ones backwards.
        first = np.concatenate([[0.0], np.cumsum(early[k:p] * early[: p - k])])
        last = np.concatenate([[0.0], np.cumsum(late[: p - k] * late[k:p])])
        for i in range(p + 1 - k):
            u, v = place[i], place[i + k]
            gram[min(u, v), max(u, v)] = sums[k] - first[p - i - k] - last[i]
    return gram + np.triu(gram, 1).T


def _least_squares(gram: np.ndarray, k: int) -> tuple[float, float]:
    """Residual sum of squares and t-value of the level, using the first ``k`` regressors."""
    a, b, c = gram[:k, :k], gram[:k, -1], gram[-1, -1]
    inverse = np.linalg.pinv(a, hermitian=True)
    beta = inverse @ b
    ssr = max(float(c - beta @ b), 0.0)
    freedom = gram[0, 0] - k
    spread = math.sqrt(ssr / freedom * inverse[1, 1]) if freedom > 0 else math.nan
    return ssr, float(beta[1] / spread) if spread > 0 else math.nan


def _residual_sums(gram: np.ndarray) -> np.ndarray:
    """Residual sums of squares with the first 2, 3, … regressors, of one factorisation for all."""
    p = gram.shape[0] - 3
    scale = np.sqrt(np.diag(gram))
    try:
        lower = np.linalg.cholesky(gram[:-1, :-1] / np.outer(scale[:-1], scale[:-1]))
        parts = np.linalg.solve(lower, gram[:-1, -1] / scale[:-1])
    except np.linalg.LinAlgError:  # columns that depend on one another
        return np.array([_least_squares(gram, k + 2)[0] for k in range(p + 1)])
    return np.maximum(gram[-1, -1] - np.cumsum(parts * parts), 0.0)[1:]


def _adf_of_series(n: int, gram: np.ndarray, head: np.ndarray, fixed: bool) -> tuple[float, float, int, int]:
    """Choose the lag by AIC on the common sample, then refit on all rows it allows.

    ``head`` holds the first values of the series, from which the extra rows of
    the refit are built. ``fixed`` takes the largest lag.
    """
    p, rows = gram.shape[0] - 3, gram[0, 0]
    lag = p
    if not fixed:
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = rows * np.log(_residual_sums(gram) / rows) + 2 * np.arange(2, p + 3)
        lag = int(np.argmin(np.where(np.isnan(aic), np.inf, aic)))
    k = lag + 2
    use = [*range(k), gram.shape[0] - 1]
    final = gram[np.ix_(use, use)].copy()
    for t in range(lag + 1, p + 1):
        row = [1.0, head[t - 1], *[head[t - i] - head[t - i - 1] for i in range(1, lag + 1)]]
        row = np.array([*row, head[t] - head[t - 1]])
        final += np.outer(row, row)
    _, stat = _least_squares(final, k)
    return stat, adf_p_value(stat), lag, int(final[0, 0])


def adf_p_value(stat: float) -> float:
    if not math.isfinite(stat):
        return math.nan
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    weights = ADF_SMALL_P if stat <= ADF_TAU_STAR else ADF_LARGE_P
    z = sum(w * stat**i for i, w in enumerate(weights))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def adf(
    df: DataFrame,
    column: str,
    *,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = HOUR,
    least: int = MIN_ROWS,
    lags: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``n, adf, adf_p, used_lag, nobs`` with a constant; the lag by AIC, or ``lags`` of them.

    A task sees one chunk of a series and gives two numbers for each lag; what meets per
    series is their sums and the first and last few values.
    """
    keys = list(series)
    complete = df.select(*keys, ts, F.col(column).cast("double").alias("__y")).where("__y IS NOT NULL")
    rows = with_positions(
        complete, series=keys, ts=ts, step_seconds=step_seconds, bucket_rows=chunk_rows,
        sums={"__sum": F.col("__y")},
    ).where(F.col("n") >= least)
    # Centring changes only the constant and keeps the sums well conditioned.
    rows = rows.select(*keys, "pos", "n", (F.col("__y") - F.col("__sum") / F.col("n")).alias("y"))
    rows = materialise(rows)  # read by three branches below
    longest = rows.agg(F.max("n")).first()[0] or 1
    reach = _lags_of(longest, lags) + 1
    spread = spread_chunks(rows, before=reach, chunk_rows=max(chunk_rows, reach))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    prefix = ", ".join(f"`{s}` {kinds[s]}" for s in keys)
    parts = (
        spread.withColumnRenamed("__home", "home")
        .groupBy(*keys, "__chunk")
        .applyInPandas(lambda pdf: _lag_sums(pdf, keys, lags), f"{prefix}, i int, v double")
    )
    sums = parts.groupBy(*keys, "i").agg(F.sum("v").alias("v")).withColumn("part", F.lit(0))
    position = F.col("pos").cast("int")
    head = rows.where(F.col("pos") <= reach).select(*keys, position.alias("i"), F.col("y").alias("v"), F.lit(1).alias("part"))
    back = (F.col("pos") - F.col("n")).cast("int")
    tail = rows.where(back >= -reach - 1).select(*keys, back.alias("i"), F.col("y").alias("v"), F.lit(2).alias("part"))
    sizes = rows.where(F.col("pos") == 0).select(
        *keys, F.lit(0).alias("i"), F.col("n").cast("double").alias("v"), F.lit(3).alias("part")
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("i")
        summed, first, last, size = (ordered.loc[ordered["part"] == k, "v"].to_numpy(float) for k in range(4))
        n = int(size[0])
        gram = _gram(n, _lags_of(n, lags), summed, first, last)
        stat, p, lag, nobs = _adf_of_series(n, gram, first, lags is not None)
        keep = {s: [pdf[s].iloc[0]] for s in keys}
        return pd.DataFrame({**keep, "n": n, "adf": stat, "adf_p": p, "used_lag": lag, "nobs": nobs})

    parts = sums.unionByName(head).unionByName(tail).unionByName(sizes)
    solved = parts.groupBy(*keys).applyInPandas(
        solve, f"{prefix}, n long, adf double, adf_p double, used_lag int, nobs long"
    )
    return nan_to_null(solved)
