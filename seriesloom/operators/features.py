"""Leak-safe features: every value uses rows strictly before the current one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, season_columns
from ..functions.numeric import RATIO_EPSILON, safe_ratio
from .chunks import CHUNK_ROWS, Builder, forward_fill, over_chunks
from .positions import with_positions

# Rows before the current one that the families below reach: 25 for the 24-step
# difference, 24 for the rolling frames.
REACH = 25


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. A family whose columns are absent is skipped."""

    target: str = "price"
    load: str = "load"
    wind: str = "wind"
    solar: str = "solar"
    net_import: str = "net_import"
    up_reserve: str = "up_reserve"
    down_reserve: str = "down_reserve"
    wind_generation: str = "wind"
    solar_generation: str = "solar"
    total_generation: str = "total_gen"


def _prior(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-rows, -1)


def rolling_statistics(column: str, window: int = 24) -> Builder:
    def build(w: WindowSpec) -> dict[str, Column]:
        frame = _prior(w, window)
        name = f"{column}_roll{window}"
        return {
            f"{name}_mean": F.avg(column).over(frame),
            f"{name}_std": F.stddev_samp(column).over(frame),
            f"{name}_min": F.min(column).over(frame),
            f"{name}_max": F.max(column).over(frame),
        }

    return build


def volatility(column: str) -> Builder:
    def build(w: WindowSpec) -> dict[str, Column]:
        last = F.lag(column, 1).over(w)
        values = {
            "d_price_1h": F.abs(last - F.lag(column, 2).over(w)),
            "d_price_24h": F.abs(last - F.lag(column, 25).over(w)),
            "std_6h": F.stddev_samp(column).over(_prior(w, 6)),
            "std_24h": F.stddev_samp(column).over(_prior(w, 24)),
        }
        return {name: F.coalesce(c, F.lit(0.0)) for name, c in values.items()}

    return build


def generation_ratios(roles: Roles) -> Builder:
    def build(w: WindowSpec) -> dict[str, Column]:
        def previous(c):
            return F.lag(c, 1).over(w)

        load = previous(roles.load)
        return {
            "wind_share": safe_ratio(previous(roles.wind), load),
            "solar_share": safe_ratio(previous(roles.solar), load),
            "import_share": safe_ratio(previous(roles.net_import), load),
        }

    return build


def _middle(values: Column) -> Column:
    """Median of a sorted array, NULL when it is empty."""
    n = F.size(values)
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def price_demand(roles: Roles, window: int = 24) -> list[Builder]:
    """Price over load, and price minus the robust z-score of load.

    Two steps: the frame is collected once (at most ``window`` values) and both
    medians come from that array.
    """
    least = max(6, window // 4)

    def collect(w: WindowSpec) -> dict[str, Column]:
        return {
            "__loads": F.sort_array(F.collect_list(roles.load).over(_prior(w, window))),
            "__load1": F.lag(roles.load, 1).over(w),
            "__price1": F.lag(roles.target, 1).over(w),
        }

    def centre(w: WindowSpec) -> dict[str, Column]:
        enough = F.size("__loads") >= least
        return {"__median": F.when(enough, _middle(F.col("__loads")))}

    def score(w: WindowSpec) -> dict[str, Column]:
        spread = F.sort_array(F.transform("__loads", lambda v: F.abs(v - F.col("__median"))))
        z = (F.col("__load1") - F.col("__median")) / (_middle(spread) + F.lit(RATIO_EPSILON))
        return {
            "price_over_load": safe_ratio("__price1", "__load1"),
            "price_minus_norm_load": F.col("__price1") - z,
        }

    return [collect, centre, score]


def system_imbalance(roles: Roles) -> Builder:
    def build(w: WindowSpec) -> dict[str, Column]:
        margin = F.lag(F.col(roles.up_reserve) - F.col(roles.down_reserve), 1).over(w)
        ratio = safe_ratio(margin, F.lag(roles.load, 1).over(w))
        return {
            "sys_margin_MW": margin,
            "imbalance_ratio": ratio,
            "price_x_imbalance": F.lag(roles.target, 1).over(w) * ratio,
        }

    return build


def distribution_shape(column: str, window: int = 24) -> list[Builder]:
    """Bias-corrected skewness and excess kurtosis of the previous ``window`` rows.

    The frame is collected once (at most ``window`` values) and centred before the
    powers are summed. The built-in moments update all their sums for every row of
    every frame, which takes several times as long.
    """
    least = max(6, window // 4)

    def collect(w: WindowSpec) -> dict[str, Column]:
        return {"__values": F.collect_list(column).over(_prior(w, window))}

    def centre(w: WindowSpec) -> dict[str, Column]:
        mean = _total("__values") / F.size("__values")
        usable = (F.size("__values") >= least) & (F.array_min("__values") < F.array_max("__values"))
        return {"__centre": F.when(usable, mean)}

    def deviate(w: WindowSpec) -> dict[str, Column]:
        # NULL where there are too few values or they are all equal.
        kept = F.when(F.col("__centre").isNotNull(), F.col("__values"))
        return {"__gaps": F.transform(kept, lambda v: v - F.col("__centre"))}

    def powers(w: WindowSpec) -> dict[str, Column]:
        n = F.size("__gaps").cast("double")
        return {
            "__count": n,
            "__m2": _total("__gaps", lambda v: v * v) / n,
            "__m3": _total("__gaps", lambda v: v * v * v) / n,
            "__m4": _total("__gaps", lambda v: v * v * v * v) / n,
        }

    def correct(w: WindowSpec) -> dict[str, Column]:
        n, m2 = F.col("__count"), F.col("__m2")
        skew = F.col("__m3") / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)
        excess = F.col("__m4") / (m2 * m2) - 3
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6)
        return {f"skew_{window}h": skew, f"kurt_{window}h": kurt}

    return [collect, centre, deviate, powers, correct]


def _total(values: str, f=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))


def renewable_share(roles: Roles) -> Builder:
    def build(w: WindowSpec) -> dict[str, Column]:
        green = F.lag(roles.wind_generation, 1).over(w) + F.lag(roles.solar_generation, 1).over(w)
        share = safe_ratio(green, F.lag(roles.total_generation, 1).over(w))
        return {
            "renew_share": share,
            "price_x_renew_share": F.lag(roles.target, 1).over(w) * share,
        }

    return build


def families(columns: Sequence[str], roles: Roles, window: int = 24) -> dict[str, list[Builder]]:
    """Builders of the families whose input columns exist."""
    have, r = set(columns), roles
    wanted = {
        "ratios": ({r.wind, r.solar, r.load, r.net_import}, [generation_ratios(r)]),
        "rolling": ({r.target}, [rolling_statistics(r.target, window)]),
        "volatility": ({r.target}, [volatility(r.target)]),
        "demand": ({r.target, r.load}, price_demand(r, window)),
        "imbalance": ({r.up_reserve, r.down_reserve, r.load, r.target}, [system_imbalance(r)]),
        "shape": ({r.target}, distribution_shape(r.target, window)),
        "renewable": (
            {r.wind_generation, r.solar_generation, r.total_generation, r.target},
            [renewable_share(r)],
        ),
    }
    return {name: builds for name, (needs, builds) in wanted.items() if needs <= have}


def add_families(
    positioned: DataFrame,
    names: Sequence[str] | None = None,
    *,
    roles: Roles = Roles(),
    window: int = 24,
    series: Sequence[str] = ("series_id",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the named lag and rolling families to a positioned panel.

    All families share one shuffle and one sort. The longest reach decides the
    overlap of the chunks.
    """
    available = families(positioned.columns, roles, window)
    chosen = [n for n in (names or available) if n in available]
    builds = [b for n in chosen for b in available[n]]
    if not builds:
        return positioned
    out = over_chunks(
        positioned, *builds, series=series, before=max(REACH, window), chunk_rows=chunk_rows
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def feature_table(
    panel: DataFrame,
    *,
    roles: Roles = Roles(),
    window: int = 24,
    series: Sequence[str] = ("series_id",),
    ts: str = "ts",
    step_seconds: int = 3600,
    bucket_rows: int = CHUNK_ROWS,
    drop_incomplete: bool = True,
    fill_rolled: bool | None = None,
) -> DataFrame:
    """Calendar, season, lag, ratio, rolling and shape features of a panel.

    Frames count rows, as in a plain row shift; put the panel through
    ``regularise`` first when frames should be true hours. Rolling columns are
    filled forward; without NULL targets only the first rows of a series lack them
    and nothing can be filled, so the step is left out. ``fill_rolled=None`` finds
    out with a scan that stored tables answer from their file statistics.
    """
    if fill_rolled is None and roles.target in panel.columns:
        fill_rolled = not panel.where(F.col(roles.target).isNull()).limit(1).isEmpty()
    positioned = with_positions(
        panel, series=series, ts=ts, step_seconds=step_seconds, bucket_rows=bucket_rows
    )
    out = add_families(
        positioned, roles=roles, window=window, series=series, chunk_rows=bucket_rows
    )
    rolled = [c for c in out.columns if c.startswith(f"{roles.target}_roll")]
    if rolled and fill_rolled:
        out = forward_fill(out, rolled, series=series, chunk_rows=bucket_rows)
    out = out.withColumns(calendar_columns(ts) | season_columns(ts)).drop("pos", "n")
    return out.dropna("any") if drop_incomplete else out


def role_columns(roles: Roles) -> set[str]:
    return set(asdict(roles).values())
