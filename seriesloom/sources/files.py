"""Path checks and lookups through the Hadoop file system, so any URI works."""

from __future__ import annotations

from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# How a forecast file is looked up from its stem.
SUFFIXES = (".csv", ".parquet", ".pq")
ALTERNATE_MARK = "_DP"


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _filesystem(spark, path)
    return fs.exists(hadoop)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    hadoop, fs = _filesystem(spark, pattern)
    found = fs.globStatus(hadoop) or []
    return sorted(status.getPath().toString() for status in found)


def move_to_free_name(spark: SparkSession, staged: str, target: str) -> str:
    """Rename a finished folder to ``target``, or to a name with the time if that is taken.

    The rename itself finds out whether a name is taken, so two writers cannot both get
    it, and readers see a whole folder or none. Returns the name that was free.
    """
    jvm = spark._jvm
    hadoop, _ = _filesystem(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop.toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    base, attempt = target.rstrip("/"), 0
    while True:
        stamp = datetime.now(UTC).strftime("%Y%m%d_%H%M%S")
        name = base if attempt == 0 else f"{base}_{stamp}" if attempt == 1 else f"{base}_{stamp}_{attempt}"
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(name), never)
            return name
        except Py4JJavaError as problem:
            if "FileAlreadyExistsException" not in problem.java_exception.getClass().getName():
                raise
        attempt += 1


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""


def resolve_predictions(spark: SparkSession, folder: str, stem: str) -> str:
    """Path of a forecast file: the stem, the marked stem, then the first match by name."""
    for name in (stem, f"{stem}{ALTERNATE_MARK}"):
        for suffix in SUFFIXES:
            path = f"{folder.rstrip('/')}/{name}{suffix}"
            if exists(spark, path):
                return path
    matches = glob(spark, f"{folder.rstrip('/')}/{stem}*.*")
    if not matches:
        raise FileNotFoundError(f"no file '{stem}*' in {folder}")
    return matches[0]
