"""Quality scores by Bradley-Terry ranking of preference pairs.

Every text becomes a short vector of measures. A labelled good text is preferred to
a labelled bad one; such pairs are formed in Spark, each text meeting the same small
number of partners. The probability that a beats b is the logistic function of the
score difference, and scores are linear in the features, so the logistic loss on
feature differences is fitted by Newton steps whose sums are taken in Spark, over all
pairs. The threshold is the quantile of the training scores at the share of bad
labels; scores are reported as probabilities on either side of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .quality_rules import measure
from .text import VISIBLE, word_slices

FEATURES = (
    "symbols", "upper", "repeat", "dup_lines", "word_length", "odd_ends", "stops", "log_words",
    "short", "line_length", "distinct", "bare", "stutter",
)
PARTNERS = 4


def _features(words) -> np.ndarray:
    m = {k: v.astype(float) for k, v in measure(words).items()}
    n, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    # Distinct words over words, for texts of any length on one scale.
    key = words.hashes() ^ (words.owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    distinct = np.bincount(words.owner[at], minlength=len(words.counts)).astype(float)
    again = np.flatnonzero(key[1:] == key[:-1])  # a word right after itself
    stutter = np.bincount(words.owner[again], minlength=len(words.counts)).astype(float)
    out = np.stack(
        [
            np.minimum(m["n_symbols"] / chars, 0.5) * 4,
            np.minimum(m["n_upper"] / np.maximum(m["n_letters"], 1), 1.0) * 2,
            m["n_repeat_words"] / n * 2,
            m["n_dup_lines"] / np.maximum(m["n_lines"], 1) * 2,
            np.minimum(chars / n, 20) / 5,
            np.minimum(m["n_odd_ends"] / n, 1.0) * 2,
            np.minimum(m["n_stops"] / n, 0.5) * 4,
            np.log1p(m["n_words"]) / 5,
            (m["n_words"] < 10).astype(float),
            np.log1p(n / np.maximum(m["n_lines"], 1)) / 3,
            np.log1p(distinct) / np.log1p(n),
            (m["n_stops"] * 60 < m["n_words"]).astype(float),
            np.minimum(stutter / n, 0.5) * 4,
        ],
        axis=1,
    )
    out[m["n_words"] == 0] = 0
    out[m["n_words"] == 0, 8] = 1
    return out


def text_features(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, features) of every text; texts without words have one fixed vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_features(w) for w in word_slices(batch.column(1), VISIBLE, lower=False)]
            if parts:
                x = np.concatenate(parts)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
                yield pa.record_batch([batch.column(0), flat.cast(pa.list_(pa.float64()))], names=[id_column, "features"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text).mapInArrow(run, f"{id_column} {kind}, features array<double>")


def preference_pairs(labelled: DataFrame, *, id_column: str, label: str, partners: int) -> DataFrame:
    """Rows with ``diff`` = features of a good text less those of a bad one.

    Good and bad texts are spread over the same cells by hash; within a cell the two
    sides are numbered, the shorter side is gone round again, and each text of the
    longer side meets ``partners`` texts of the other one.
    """
    side = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).alias("y"), id_column, "features")
    totals = {r["y"]: r["count"] for r in side.groupBy("y").count().collect()}
    if len(totals) < 2:
        return side.select(F.col("features").alias("diff")).limit(0)
    cells = max(1, min(totals.values()) // 50)
    tagged = side.withColumn("cell", F.pmod(F.xxhash64(F.lit(11), id_column), F.lit(cells)))
    place = F.row_number().over(Window.partitionBy("cell", "y").orderBy(F.xxhash64(F.lit(12), id_column), id_column)) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("cell", "y"))
    numbered = tagged.withColumn("place", place).withColumn("size", size)
    good = numbered.where("y = 1").select("cell", F.col("place").alias("p"), F.col("size").alias("np"), F.col("features").alias("x"))
    bad = numbered.where("y = 0").select("cell", F.col("place").alias("q"), F.col("size").alias("nq"), F.col("features").alias("z"))
    sizes = bad.select("cell", "nq").distinct()
    meeting = (
        good.join(sizes, "cell")
        .withColumn("rounds", F.greatest(F.lit(partners), F.ceil(F.col("nq") / F.col("np"))))
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.least(F.col("rounds"), F.col("nq")) - 1)))
        .withColumn("q", (F.col("p") + F.col("r") * F.greatest(F.lit(1), F.least("np", F.floor(F.col("nq") / F.col("rounds"))))) % F.col("nq"))
    )
    return meeting.join(bad.drop("nq"), ["cell", "q"]).select(F.zip_with("x", "z", lambda a, b: a - b).alias("diff"))


def fit_bradley_terry(pairs: DataFrame, size: int, *, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights that minimise the logistic loss on feature differences plus a ridge."""
    weights = np.zeros(size)
    for _ in range(rounds):
        now = weights.copy()

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            gradient, curvature = np.zeros(size), np.zeros((size, size))
            for batch in batches:
                d = batch.column(0).values.to_numpy()[: batch.num_rows * size].reshape(-1, size)
                p = 1 / (1 + np.exp(np.clip(d @ now, -50, 50)))  # of the wrong order
                gradient += p @ d
                curvature += (d * (p * (1 - p))[:, None]).T @ d
            both = np.concatenate([gradient, curvature.ravel()])
            yield pa.record_batch([pa.array(np.arange(len(both))), pa.array(both)], names=["i", "v"])

        rows = pairs.select("diff").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(size + size * size)
        for r in rows:
            total[r["i"]] = r["v"]
        step = np.linalg.solve(
            total[size:].reshape(size, size) + ridge * np.eye(size), total[:size] - ridge * weights
        )
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights


@dataclass(frozen=True)
class QualityModel:
    """Weights of the features and the raw score at which a text is as likely good as bad."""

    weights: tuple[float, ...]
    cut: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cut - features @ np.array(self.weights), -50, 50)))


def is_held_out(id_column: str) -> Column:
    """Whether the crc32 of the id, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(
    features: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", label: str = "quality", partners: int = PARTNERS
) -> QualityModel:
    """The ranking of ``features`` (id, features) learnt from the labels that are not held out.

    An id with labels that contradict one another is not learnt from.
    """
    held = is_held_out(id_column)
    known = labels.where(~held).groupBy(id_column).agg(F.min(label).alias(label), F.max(label).alias("__other"))
    known = known.where(F.col(label) == F.col("__other")).drop("__other")
    labelled = materialise(features.where(~held).join(known, id_column))
    pairs = materialise(preference_pairs(labelled, id_column=id_column, label=label, partners=partners))
    weights = fit_bradley_terry(pairs, len(FEATURES))
    raw = F.lit(0.0)
    for i, w in enumerate(weights.tolist()):
        raw = raw + F.lit(w) * F.col("features")[i]
    # Quantile of the training scores at the share of bad labels; accuracy 1e-4 of the ranks.
    trained = labelled.where(F.col(label).isin(0, 1)).select(raw.alias("s"), F.col(label).alias("y"))
    share = trained.agg(F.avg(F.when(F.col("y") == 0, 1.0).otherwise(0.0))).first()[0]
    cut = 0.0
    if share is not None:
        cut = trained.agg(F.percentile_approx("s", float(share), 10_000)).first()[0]
    return QualityModel(tuple(weights.tolist()), float(cut))


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    partners: int = PARTNERS,
) -> DataFrame:
    """id, held_out, score and predicted of every document.

    Documents whose crc32 of the id, modulo 3, is 1 are held out: their labels are
    never read. Scores come from the text alone. Null and empty texts have the
    features of a text without words and get its score. Labels other than 0 and 1,
    contradicting labels of one id and null ids are not learnt from; with no pair of
    labels every score is 0.5. Repeated rows are each returned; ties get equal scores;
    further columns are ignored; an empty table gives an empty result.
    """
    features = materialise(text_features(documents, id_column=id_column, text=text))
    model = fit_quality(features, labels, id_column=id_column, label=label, partners=partners)
    kind = features.schema[id_column].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found)], names=[id_column, "held_out", "score"])

    scored = features.select(id_column, is_held_out(id_column).alias("held_out"), "features")
    scored = scored.mapInArrow(score, f"{id_column} {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(
    documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """The documents with a score of one half or more; columns are those of the input.

    Learnt as in ``score_quality``. Texts are scored where they are read, so only
    features are ever shuffled; rows are judged by their own text, repeated or not.
    """
    features = materialise(text_features(documents, id_column=id_column, text=text))
    model = fit_quality(features, labels, id_column=id_column, label=label)
    columns = documents.columns
    place = columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(place), VISIBLE, lower=False):
                good = model.scores(_features(words)) >= 0.5
                yield batch.slice(words.rows.start, len(words.rows)).filter(pa.array(good))

    return documents.mapInArrow(keep, documents.schema)
