"""End-to-end jobs: features, backtests, consolidation, rank fusion, evaluation."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, season_columns
from ..operators.backtest import block_backtest, walk_forward
from ..operators.baselines import to_long
from ..operators.arma import SARIMAX_ORDER, SARIMAX_SEASONAL, SeasonalArma
from ..operators.autoregression import seasonal_autoregression
from ..operators.chunks import CHUNK_ROWS, forward_fill
from ..operators.comparison import diebold_mariano, dm_summary, sorted_summary, wide_predictions
from ..operators.features import Roles, add_families
from ..operators.folds import BLOCK_ROWS, HORIZONS, N_BLOCKS, N_SPLITS
from ..operators.forecasters import (
    EXOGENOUS_BLACKLIST,
    CrossValidatedBoosting,
    Forecaster,
    GradientBoosting,
    exogenous_columns,
)
from ..operators.grid import keep_first
from ..operators.importance import TOP, permutation_importance, top_importance
from ..operators.imputation import ForestSettings, impute_forest
from ..operators.merge import (
    FORECAST_MODELS,
    coerce_columns,
    merge_blocks,
    merge_forecasts,
    side_by_side,
    sort_rankings,
    union_rankings,
)
from ..operators.metrics import (
    accuracy,
    common_timestamps,
    fold_summary,
    last_fold,
    pooled_ranking,
    walk_forward_ranking,
)
from ..operators.peaks import PEAK_QUANTILES, best_peak_models, month_view, peak_metrics, peak_thresholds
from ..operators.positions import with_positions
from ..operators.profile import HIGH_CORRELATION, drop_constant, drop_correlated
from ..operators.ranking import (
    fuse,
    metric_table,
    model_weights,
    rank_heatmap,
    rank_lists,
    top_features,
)
from ..session import materialise
from ..sources.files import exists, resolve_predictions
from ..sources.readers import (
    covered_models,
    parse_timestamps,
    read_importance_lists,
    read_predictions,
    read_smart_csv,
    report_rejected,
)
from ..sources.writers import write_complete, write_forecasts, write_report, write_summary, write_table

log = logging.getLogger(__name__)

# The roles' column names in the raw hourly table.
RAW_ROLES = Roles(
    target="fixing_i_price",
    load="zapotrzebowanie_na_moc",
    wind="pl_produkcja_wiatr",
    solar="pl_produkcja_slonce",
    net_import="saldo_wymiany_miedzysystemowej_rownoleglej",
    up_reserve="rezerwa_mocy_ponad_zapotrzebowanie",
    down_reserve="rezerwa_mocy_ponizej_zapotrzebowania",
    wind_generation="generacja_zrodel_wiatrowych",
    solar_generation="generacja_zrodel_fotowoltaicznych",
    total_generation="sumaryczna_generacja_JGxx",
)

@dataclass(frozen=True)
class ConsolidationInputs:
    """Files to consolidate, relative to the job's folder.

    ``forecasts`` maps an output label to a pair of forecast files, ``importance``
    a file to the prefixes of its list columns, in output order.
    """

    forecasts: dict[str, tuple[str, str]] = field(default_factory=dict)
    blocks: dict[str, tuple[str, str]] = field(default_factory=dict)
    importance: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rankings: tuple[str, ...] = ()


@dataclass(frozen=True)
class FeatureJob:
    """Settings of the feature job."""

    roles: Roles = Roles()
    series: tuple[str, ...] = ("series_id",)
    ts: str = "ts"
    step_seconds: int = 3600
    window: int = 24
    correlation: float = HIGH_CORRELATION
    order: tuple[str, ...] = ()
    forest: ForestSettings = field(default_factory=ForestSettings)


def build_features(raw: DataFrame, job: FeatureJob = FeatureJob()) -> DataFrame:
    """Raw panel to feature table: dedupe, prune, impute, engineer, impute again.

    Pruning and imputation need results on the driver (column names, medians), so
    the table is stored before and between those steps. The rows keep their
    NULLs; ``write_complete`` drops incomplete ones at the sink.
    """
    keys, target = [*job.series, job.ts], job.roles.target
    order = list(job.order) or [c for c in raw.columns if c not in keys]
    table = materialise(keep_first(raw, keys=keys, order=order))
    numbers = [c for c in table.columns if c not in keys]
    kept, constant = drop_constant(table.select(*numbers))
    kept, correlated = drop_correlated(kept, threshold=job.correlation, protected=[target])
    log.info("dropped constant %s and correlated %s", constant, correlated)
    table = impute_forest(table.select(*keys, *kept.columns), target, settings=job.forest)
    positioned = with_positions(
        materialise(table), series=job.series, ts=job.ts, step_seconds=job.step_seconds
    )
    dated = positioned.withColumns(calendar_columns(job.ts) | season_columns(job.ts))
    out = add_families(dated, roles=job.roles, window=job.window, series=job.series)
    rolled = [c for c in out.columns if c.startswith(f"{target}_roll")]
    if rolled:
        out = forward_fill(materialise(out), rolled, series=job.series, chunk_rows=CHUNK_ROWS)
    out = materialise(out.drop("pos", "n"))
    return impute_forest(out, target, settings=job.forest)


def feature_job(raw: DataFrame, path: str, job: FeatureJob = FeatureJob()) -> int:
    """Write the complete rows of the feature table; returns how many were dropped."""
    return write_complete(build_features(raw, job), path)


def default_models(rounds: int | None = None) -> dict[str, Forecaster]:
    """The two boosting models; ``rounds`` caps both for a quick run."""
    if rounds is None:
        return {"XGB": CrossValidatedBoosting(), "GBR": GradientBoosting()}
    return {
        "XGB": CrossValidatedBoosting(max_rounds=rounds),
        "GBR": GradientBoosting(max_rounds=rounds),
    }


def backtest_job(
    features: DataFrame,
    target: str,
    folder: str,
    *,
    models: dict[str, Forecaster] | None = None,
    horizons: Sequence[int] = HORIZONS,
    splits: int = N_SPLITS,
    block: int = BLOCK_ROWS,
    blocks: int = N_BLOCKS,
    blacklist: Sequence[str] = EXOGENOUS_BLACKLIST,
    importance_repeats: int = 10,
    step_seconds: int = 3600,
) -> DataFrame:
    """Walk-forward forecasts, block backtest, importances and the ranking; returns the ranking."""
    models = models or default_models()
    rows = materialise(with_positions(features, step_seconds=step_seconds))
    names = exogenous_columns(features, target)
    exogenous = exogenous_columns(features, target, blacklist)

    def autoregressions(hs, folds, spare):
        plain = seasonal_autoregression(rows, target, hs, folds, name="SARIMA", spare=spare)
        more = seasonal_autoregression(
            rows, target, hs, folds, name="SARIMAX", exogenous=exogenous, spare=spare
        )
        return plain.unionByName(more)

    found = walk_forward(rows, models, target, names, horizons, splits)
    found = materialise(found.unionByName(autoregressions(horizons, splits, 1)))
    labels = [*models, "SARIMA", "SARIMAX"]
    for h in horizons:
        latest = last_fold(found.where(F.col("horizon") == h), splits)
        latest = common_timestamps(latest, len(labels))
        wide = wide_predictions(latest, labels).select(
            "series_id", "ts", *labels, F.col("y").alias("Observed")
        )
        write_forecasts(wide, f"{folder}/forecasts_h{h}_hours")
    importance_of = models | {"SARIMAX": SeasonalArma(SARIMAX_ORDER, SARIMAX_SEASONAL)}
    tail = block_backtest(rows, models, target, names, block=block, blocks=blocks)
    tail = materialise(tail.unionByName(autoregressions([block], blocks, 0)))
    wide = wide_predictions(tail, labels).withColumnRenamed("y", "Observed")
    write_forecasts(wide, f"{folder}/recursive_blocks_h{block}x{blocks}")
    pooled = pooled_ranking(tail)
    write_table(pooled.orderBy("series_id", "rank"), f"{folder}/ranking_recursive_blocks")
    for name, model in importance_of.items():
        # The seasonal model is judged by its exogenous columns.
        columns = exogenous if name == "SARIMAX" else names
        grown = permutation_importance(rows, model, target, columns, repeats=importance_repeats)
        write_report(top_importance(grown, TOP), f"{folder}/feature_importance_{name.lower()}")
    scores = walk_forward_ranking(found)
    blocks_row = pooled.select(
        "series_id", "model", F.lit(block * blocks).alias("horizon"), "MAE", "RMSE", "MAPE",
        F.lit(None).cast("double").alias("RMSLE"), F.lit(None).cast("double").alias("R2"),
    )
    ranking = materialise(
        scores.unionByName(blocks_row).withColumnRenamed("horizon", "HorizonHours")
    )
    write_table(sort_rankings(ranking), f"{folder}/ranking_models")
    return ranking


def kfold_job(
    features: DataFrame,
    target: str,
    folder: str,
    model: Forecaster,
    label: str,
    *,
    horizons: Sequence[int] = HORIZONS,
    splits: int = 3,
    step_seconds: int = 3600,
) -> DataFrame:
    """K-fold run of one model: a forecast CSV per horizon and fold, a JSON summary."""
    rows = with_positions(features, step_seconds=step_seconds)
    names = exogenous_columns(features, target)
    found = materialise(walk_forward(rows, {label: model}, target, names, horizons, splits))
    wide = found.select(
        "series_id", "horizon", "fold", "ts", F.col("y").alias("Observed"), F.col("yhat").alias(label)
    )
    write_forecasts(wide, f"{folder}/kfold", partition_by=["horizon", "fold"])
    per_fold = accuracy(found, ["series_id", "horizon", "fold"], null_safe=True)
    summary = fold_summary(per_fold, ["series_id", "horizon"])
    write_summary(summary, f"{folder}/kfold_summary")
    return summary


def _optional(spark: SparkSession, path: str, position: bool = False, rejected: str | None = None) -> DataFrame | None:
    if not exists(spark, path):
        log.warning("skipped, not found: %s", path)
        return None
    good, bad = read_smart_csv(spark, path, position=position)
    report_rejected(path, bad, rejected and f"{rejected}/{path.rstrip('/').rsplit('/', 1)[-1]}")
    return good


def merged_forecasts(spark: SparkSession, left: str, right: str, rejected: str | None = None) -> DataFrame | None:
    """Outer merge of two forecast files by timestamp; ``rejected`` is a folder for malformed lines."""
    tables = [_optional(spark, p, rejected=rejected) for p in (left, right)]
    if None in tables:
        return None
    ready = [parse_timestamps(coerce_columns(t, ["Observed", *FORECAST_MODELS])) for t in tables]
    return merge_forecasts(*ready)


def merged_blocks(spark: SparkSession, left: str, right: str, rejected: str | None = None) -> DataFrame | None:
    """Inner merge of two block forecast files."""
    tables = [_optional(spark, p, rejected=rejected) for p in (left, right)]
    if None in tables:
        return None
    ready = [
        parse_timestamps(coerce_columns(t, [c for c in t.columns if c != "timestamp"])) for t in tables
    ]
    return merge_blocks(*ready)


def merged_importance(
    spark: SparkSession, folder: str, files: dict[str, tuple[str, ...]], rejected: str | None = None
) -> DataFrame | None:
    """Importance files side by side; missing files are skipped."""
    frames = []
    for name, prefixes in files.items():
        lists = _optional(spark, f"{folder}/{name}", position=True, rejected=rejected)
        if lists is None:
            continue
        wanted = [f"{p}_{kind}" for p in prefixes for kind in ("feature", "importance")]
        lists = coerce_columns(lists, [c for c in wanted if c.endswith("_importance")])
        frames.append(lists.select("pos", *[c for c in wanted if c in lists.columns]))
    return side_by_side(frames) if frames else None


def consolidate_job(
    spark: SparkSession, folder: str, inputs: ConsolidationInputs, out: str
) -> list[str]:
    """Merge forecasts, importances, blocks and rankings; returns the tables written.

    An output whose inputs are missing is skipped with a warning. Lines with a wrong
    field count are kept by file name under ``rejected`` next to the outputs.
    """
    done = []
    rejected = f"{out}/rejected"

    def save(df: DataFrame | None, name: str, write=write_report) -> None:
        if df is not None:
            write(df, f"{out}/{name}")
            done.append(name)

    def by_time(df: DataFrame, path: str) -> None:
        write_table(df.orderBy("timestamp"), path)

    for label, pair in inputs.forecasts.items():
        save(merged_forecasts(spark, *[f"{folder}/{f}" for f in pair], rejected), f"forecasts_{label}", by_time)
    wide = merged_importance(spark, folder, inputs.importance, rejected)
    save(wide.orderBy("pos").drop("pos") if wide is not None else None, "feature_importance")
    for label, pair in inputs.blocks.items():
        save(merged_blocks(spark, *[f"{folder}/{f}" for f in pair], rejected), label, by_time)
    rankings = [_optional(spark, f"{folder}/{f}", rejected=rejected) for f in inputs.rankings]
    if rankings and None not in rankings:
        save(sort_rankings(union_rankings(rankings)), "ranking_models")
    return done


def fuse_rankings(
    lists: DataFrame,
    rankings: DataFrame | None = None,
    *,
    metric: str = "MAE",
    horizon: int = 168,
    aliases: dict[str, str] | None = None,
    rank_by: str = "position",
    renormalise: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Ranks per model and fused scores per feature from importance lists."""
    ranks = materialise(rank_lists(lists, aliases=aliases, rank_by=rank_by))
    metrics = None
    if rankings is not None:
        metrics = metric_table(rankings, metric=metric, horizon=horizon)
        if metrics.isEmpty():
            raise ValueError(f"no ranking rows for horizon {horizon}")
    weights = model_weights(ranks.select("model"), metrics, metric=metric, renormalise=renormalise)
    return ranks, fuse(ranks, weights)


def ranking_job(
    spark: SparkSession, lists_path: str, metrics_path: str | None, out: str
) -> DataFrame:
    """Fuse a merged importance file, weighted by a ranking file when there is one."""
    rankings = None
    if metrics_path and exists(spark, metrics_path):
        rankings, bad = read_smart_csv(spark, metrics_path)
        report_rejected(metrics_path, bad)
    lists = read_importance_lists(spark, lists_path)
    ranks, fused = fuse_rankings(lists, rankings)
    models = [r["model"] for r in ranks.select("model").distinct().orderBy("model").collect()]
    if len(models) < 2:
        raise ValueError(f"need the lists of two models, have {models}")
    fused = materialise(fused)
    write_report(
        fused.orderBy(F.col("final_score").desc(), "feature"), f"{out}/feature_ranking_aggregated", bom=True
    )
    write_report(rank_heatmap(ranks, top_features(fused), models), f"{out}/heatmap_ranks")
    return fused


def evaluate_wide(
    wide: DataFrame, models: Sequence[str], *, ts: str = "timestamp", fixed: float | None = None
) -> dict[str, DataFrame]:
    """Peak metrics, pairwise tests, their summary and the month view of a forecast table."""
    named = wide.withColumnsRenamed({ts: "ts", "Observed": "y"})
    if "series_id" not in named.columns:
        named = named.withColumn("series_id", F.lit("series"))
    named = materialise(named)
    long = to_long(named, models, ["series_id", "ts"])
    limits = materialise(peak_thresholds(named, fixed=fixed))
    peaks = materialise(peak_metrics(long, limits))
    best = best_peak_models(peaks, q=PEAK_QUANTILES[0])
    tests = materialise(diebold_mariano(named, models))
    return {
        "peak_metrics": peaks,
        "dm_raw": tests,
        "dm_summary": dm_summary(tests),
        "month_view": month_view(long, best),
    }


def evaluation_job(
    spark: SparkSession, folder: str, stem: str, out: str, *, keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Evaluate the forecast file that ``stem`` names and write its tables.

    ``keys=['series_id']`` evaluates each series of a panel file on its own.
    """
    wide = read_predictions(spark, resolve_predictions(spark, folder, stem), keys=keys)
    models = covered_models(wide)
    if not models:
        raise ValueError("no model column has enough values")
    tables = evaluate_wide(wide, models)
    write_table(tables["peak_metrics"].orderBy("series_id", F.col("q").desc(), "model"), f"{out}/peak_metrics_{stem}")
    write_table(tables["dm_raw"].orderBy("series_id", "pair", "loss"), f"{out}/dm_raw_{stem}")
    write_table(sorted_summary(tables["dm_summary"]), f"{out}/dm_summary_{stem}")
    write_table(tables["month_view"].orderBy("series_id", "ts", "place"), f"{out}/month_view_{stem}")
    return tables


__all__ = [
    "ConsolidationInputs", "FeatureJob", "RAW_ROLES", "backtest_job", "build_features", "consolidate_job",
    "default_models", "evaluate_wide", "evaluation_job", "feature_job", "fuse_rankings", "kfold_job",
    "merged_blocks", "merged_forecasts", "merged_importance", "ranking_job",
]
