"""Readers. Missing or unreadable feature inputs give an empty table and a warning."""

from __future__ import annotations

import csv
import logging
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan_to_null, to_number
from ..functions.text import BOM, clean_header
from ..operators.chunks import forward_fill
from ..operators.grid import regularise
from ..operators.positions import with_positions
from ..operators.profile import constant_columns
from ..session import materialise
from .files import exists, suffix_of

log = logging.getLogger(__name__)

# Accepted names of the time column, and separators of a CSV in the
# order they are tried.
TIME_ALIASES = ("datetime", "timestamp")
SEPARATORS = (",", ";", "\t", "|")
REJECT = "__rejected"


def empty_table(spark: SparkSession, schema: T.StructType | None = None) -> DataFrame:
    return spark.createDataFrame([], schema or T.StructType([]))


def parse_time(c) -> Column:
    """Text or timestamp to TIMESTAMP_NTZ, unparseable to NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("timestamp_ntz")


def coerce_time(df: DataFrame, column: str = "datetime") -> tuple[DataFrame, str]:
    """Parse the time column and drop rows without one; returns the column used.

    Rows that repeat the header inside the data go too. The result is not sorted:
    every window and sink names its own order.
    """
    if column not in df.columns:
        if "timestamp" not in df.columns:
            raise KeyError(f"no column '{column}' and no 'timestamp'")
        column = "timestamp"
    if isinstance(df.schema[column].dataType, T.StringType):
        text = F.trim(column)
        df = df.where(~F.coalesce(F.lower(text).isin(*TIME_ALIASES), F.lit(False)))
        df = df.withColumn(column, parse_time(text))
    else:
        df = df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    return df.dropna(subset=[column]), column


def read_table(
    spark: SparkSession,
    path: str,
    datetime_column: str = "datetime",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Parquet or CSV by suffix, with a parsed time column.

    A missing, unreadable or unknown file gives an empty table. Give ``schema`` for
    large CSV files: without it Spark scans the file once more to infer types.
    """
    suffix = suffix_of(path)
    if not exists(spark, path):
        log.warning("input not found: %s", path)
        return empty_table(spark)
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        if suffix in (".parquet", ".pq"):
            raw = reader.parquet(path)
        elif suffix == ".csv":
            raw = reader.csv(path, header=True, inferSchema=schema is None)
        else:
            log.warning("unsupported suffix '%s': %s", suffix, path)
            return empty_table(spark)
        return coerce_time(nan_to_null(raw), datetime_column)[0]
    except (PySparkException, Py4JJavaError, KeyError) as problem:
        log.warning("cannot read %s: %s", path, problem)
        return empty_table(spark)


def read_features(
    spark: SparkSession,
    path: str,
    datetime_column: str = "datetime",
    *,
    series: Sequence[str] = (),
) -> DataFrame:
    """Feature table on its hourly grid without incomplete rows.

    Without ``series`` columns the file is one series and gets a constant
    ``series_id``.
    """
    raw = read_table(spark, path, datetime_column)
    if not raw.columns:
        return raw
    column = datetime_column if datetime_column in raw.columns else "timestamp"
    return on_hourly_grid(raw, column, series).dropna("any")


def on_hourly_grid(raw: DataFrame, column: str, series: Sequence[str]) -> DataFrame:
    panel = raw.withColumnRenamed(column, "ts")
    if not series:
        panel = panel.withColumn("series_id", F.lit("series"))
    return regularise(panel, series=series or ("series_id",), ts="ts")


def read_model_table(
    spark: SparkSession, uri: str, target: str, *, series: Sequence[str] = ()
) -> DataFrame:
    """Model input from any Hadoop URI: hourly grid, target present, rest filled forward.

    Columns with at most one distinct value are dropped.
    """
    raw = nan_to_null(spark.read.parquet(uri))
    known = [c for c in TIME_ALIASES if c in raw.columns]
    if not known:
        raise ValueError(f"need one of the columns {TIME_ALIASES}")
    keys = list(series) or ["series_id"]
    panel = on_hourly_grid(coerce_time(raw, known[0])[0], known[0], series).dropna(subset=[target])
    values = [c for c in panel.columns if c not in (*keys, "ts")]
    filled = forward_fill(with_positions(panel, series=keys), values, series=keys).drop("pos", "n")
    constant = [r["column_name"] for r in constant_columns(filled, values).where("constant").collect()]
    return filled.drop(*constant)


def sniff_separator(header: str) -> str:
    """The candidate that occurs most often outside quotes; comma when none does."""
    plain = "".join(part for i, part in enumerate(header.split('"')) if i % 2 == 0)
    best = max(SEPARATORS, key=plain.count)
    return best if plain.count(best) else SEPARATORS[0]


def read_smart_csv(
    spark: SparkSession, path: str, *, typed: bool = False, position: bool = False
) -> tuple[DataFrame, DataFrame]:
    """CSV with unknown separator as trimmed text; returns good rows and rejected lines.

    The separator comes from the header line, byte order marks are stripped from
    every header, and a line whose field count differs from the header is rejected
    instead of being read shifted. ``typed`` turns columns that hold only numbers
    into doubles; ``position`` adds the line order as ``pos``.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    first = spark.read.text(path).limit(1).first()
    header = (first[0] if first else "").strip(BOM)
    separator = sniff_separator(header)
    names = [clean_header(c) for c in next(csv.reader([header], delimiter=separator), [])]
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*fields, T.StructField(REJECT, T.StringType())])
    # With pruning the parser would not see that a line has too many fields.
    raw = spark.read.option("columnPruning", "false").csv(
        path, schema=schema, sep=separator, header=True, enforceSchema=True,
        mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    extra = []
    if position:
        raw = _with_line_numbers(raw)
        extra = ["pos"]
    # Reading a data column along keeps both tables countable: Spark refuses to scan a CSV
    # for the raw line alone.
    seen = F.coalesce("c0", F.lit("")) >= "" if names else F.lit(True)
    good = raw.where(F.col(REJECT).isNull() & seen).select(
        *[F.trim(f"c{i}").alias(n) for i, n in enumerate(names)], *extra
    )
    bad = raw.where(F.col(REJECT).isNotNull() & seen).select(F.col(REJECT).alias("line"))
    return (infer_numbers(good) if typed else good), bad


def _with_line_numbers(raw: DataFrame) -> DataFrame:
    """Add ``pos``: the 0-based number of the data line, counted over splits and part files.

    A split is one run of consecutive ids within its partition; splits follow each other
    by file name and offset. Only a row per split meets in one place. The ids are stored
    once, so that both uses of them see the same ones.
    """
    source = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    lines = materialise(raw.select("*", *source, F.monotonically_increasing_id().alias("__id")))
    splits = lines.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__first"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "__file", "__block", (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    return (
        lines.join(offsets, ["__file", "__block"])
        .withColumn("pos", F.col("__id") + F.col("__shift"))
        .drop("__file", "__block", "__id", "__shift")
    )


def report_rejected(path: str, bad: DataFrame, keep: str | None = None) -> int:
    """Number of rejected lines of a file; they are logged, and kept as a text table in ``keep``."""
    count = bad.count()
    if count:
        log.warning("%s: %s lines with a wrong field count rejected, first: %s", path, count, bad.first()["line"])
        if keep:
            bad.write.mode("append").text(keep)
    return count


def infer_numbers(df: DataFrame) -> DataFrame:
    """Cast text columns to double where every non-empty value is a number."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    filled = {c: F.when(F.col(c) != "", F.col(c)) for c in texts}
    checks = [
        (F.count(filled[c].try_cast("double")) == F.count(filled[c])).alias(f"__{i}")
        for i, c in enumerate(texts)
    ]
    flags = df.agg(*checks).first()
    numbers = [c for c, ok in zip(texts, flags) if ok]
    return df.withColumns({c: filled[c].try_cast("double") for c in numbers}) if numbers else df


def parse_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Parse or drop; a table without the column passes unchanged."""
    if column not in df.columns:
        return df
    return df.withColumn(column, parse_time(column)).dropna(subset=[column])


def read_predictions(
    spark: SparkSession,
    path: str,
    *,
    ts: str = "timestamp",
    observed: str = "Observed",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Wide forecast file: time and target required, everything else but ``keys`` numeric or NULL."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    suffix = suffix_of(path)
    if suffix == ".csv":
        raw = spark.read.csv(path, header=True)
        raw = raw.toDF(*[clean_header(c) for c in raw.columns])
    elif suffix in (".parquet", ".pq"):
        raw = spark.read.parquet(path)
    else:
        raise ValueError("input must be .csv or .parquet")
    if ts not in raw.columns or observed not in raw.columns:
        raise ValueError(f"need columns '{ts}' and '{observed}', have {raw.columns}")
    numbers = {c: F.col(c).try_cast("double") for c in raw.columns if c not in (ts, *keys)}
    out = nan_to_null(raw.withColumn(ts, parse_time(F.col(ts))).withColumns(numbers))
    return out.dropna(subset=[ts, observed])


def covered_models(
    wide: DataFrame, *, ts: str = "timestamp", observed: str = "Observed", least: float = 0.5
) -> list[str]:
    """Numeric model columns of a wide table with enough non-null values."""
    names = [
        f.name
        for f in wide.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in (ts, observed)
    ]
    shares = wide.agg(*[F.avg(F.col(c).isNotNull().cast("double")) for c in names]).first()
    return [c for c, share in zip(names, shares) if share is not None and share >= least]


def read_importance_lists(spark: SparkSession, path: str) -> DataFrame:
    """``model, pos, feature`` of a merged importance file, empty labels removed."""
    from ..operators.ranking import unpivot_lists

    good, bad = read_smart_csv(spark, path, position=True)
    report_rejected(path, bad)
    return unpivot_lists(good).where("feature IS NOT NULL AND feature != ''")


def read_rankings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ranking file as text columns with numbers coerced; malformed lines apart."""
    good, bad = read_smart_csv(spark, path)
    return good.withColumns({c: to_number(c) for c in good.columns if c != "model"}), bad
