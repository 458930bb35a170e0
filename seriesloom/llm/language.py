"""Languages of a text as a mixture, inferred by expectation-maximisation.

Spark counts letter trigrams per language over all training texts. A word then has a
likelihood under each language, the product over its trigrams, and a text is taken as
drawn word by word from a mixture of languages. EM estimates the proportions; the set
of languages, of any size, is the one with the best likelihood after a penalty per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import byte_class, mix, text_bytes, slices, words_of

BUCKETS = 1 << 15
MAX_LANGUAGES = 200
LETTERS = byte_class(b"abcdefghijklmnopqrstuvwxyz")
_CLEAN = np.where(LETTERS, np.arange(256), 32).astype(np.uint64)
ROUNDS, SMOOTHING, PENALTY = 8, 0.5, 1.0


def _trigrams(words) -> np.ndarray:
    """Bucket of the trigram around each byte; everything but letters counts as a space."""
    b = _CLEAN[words.buf]
    code = b << np.uint64(8)
    code[1:] |= b[:-1] << np.uint64(16)
    code[0] |= np.uint64(32 << 16)
    code[:-1] |= b[1:]
    code[-1] |= np.uint64(32)
    return (mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)


def trigram_counts(training: DataFrame, *, text: str = "text", language: str = "lang") -> DataFrame:
    """(lang, counts): letters' trigrams of each language by bucket, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            texts = text_bytes(batch.column(0))
            for rows in slices(texts):
                w = words_of(texts[rows.start : rows.stop], rows, LETTERS, True)
                inside = LETTERS[w.buf]
                code = _trigrams(w)
                for i, row in enumerate(rows):
                    span = slice(w.at[i], w.at[i + 1])
                    found = np.bincount(code[span][inside[span]], minlength=BUCKETS)
                    if names[row] in sums:
                        sums[names[row]] += found
                    else:
                        sums[names[row]] = found
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = training.select(text, language).where(F.col(language).isNotNull() & F.col(text).isNotNull())
    parts = rows.mapInArrow(run, "lang string, bucket int, n long")
    summed = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS entries per language.
    return summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))


class LanguageModel:
    """Smoothed log-probabilities of trigram buckets, a column per language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        table = np.stack([counts[n] for n in self.names], axis=1).astype(float) if counts else np.zeros((BUCKETS, 0))
        self.log = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BUCKETS))
        total = table.sum(axis=0)
        self.prior = (total + 1) / (total + 1).sum() if counts else total

    @classmethod
    def from_counts(cls, counts: DataFrame) -> LanguageModel:
        rows = counts.limit(MAX_LANGUAGES + 1).collect()
        if len(rows) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        tables = {}
        for r in rows:
            tables[r["lang"]] = np.zeros(BUCKETS)
            tables[r["lang"]][[c["bucket"] for c in r["counts"]]] = [c["n"] for c in r["counts"]]
        return cls(tables)

    def word_logs(self, words) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        code = _trigrams(words)
        out = np.empty((len(words.starts), len(self.names)))
        total = np.zeros(len(code) + 1)
        for j in range(len(self.names)):
            np.cumsum(self.log[:, j][code], out=total[1:])
            out[:, j] = total[words.ends] - total[words.starts]
        return out


def _em(p: np.ndarray, owner: np.ndarray, first: np.ndarray, start: np.ndarray, rounds: int):
    """Proportions per text (rows of ``start``) and the log of each word's mixture likelihood."""
    share = start
    sizes = np.diff(np.append(first, len(p)))[:, None]
    for _ in range(rounds):
        r = p * share[owner]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        share = (np.add.reduceat(r, first, axis=0) + 0.1 * start) / (sizes + 0.1)
    return share, np.log(np.maximum((p * share[owner]).sum(axis=1), 1e-300))


def infer(model: LanguageModel, words) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, selected) of the texts of a slice, languages in columns; texts without words: 0."""
    n, m = len(words.counts), len(model.names)
    shares, chosen = np.zeros((n, m)), np.zeros((n, m), dtype=bool)
    texts = np.flatnonzero(words.counts)
    if not len(texts) or not m:
        return shares, chosen
    logs = model.word_logs(words)
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top)
    counts = words.counts[texts]
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    full, _ = _em(p, owner, first, np.tile(model.prior, (len(texts), 1)), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.full(len(texts), -np.inf)
    for size in range(1, m + 1):
        penalty = PENALTY * (size - 1) * (np.log(counts + 1) + 2)
        # No word's likelihood exceeds 1 here, so a text at or above this bound is settled for all larger sets.
        open_ = -penalty > best
        if not open_.any():
            break
        own, n_own = full[open_], counts[open_]
        at = np.cumsum(n_own) - n_own
        mask = np.zeros_like(own, dtype=bool)
        np.put_along_axis(mask, order[open_, :size], True, axis=1)
        start = own * mask
        start /= start.sum(axis=1, keepdims=True)
        q = p if open_.all() else p[open_[owner]]
        share, each = _em(q, np.repeat(np.arange(len(n_own)), n_own), at, start, 0 if size == 1 else ROUNDS // 2)
        value = np.add.reduceat(each, at) - penalty[open_]
        better = value > best[open_]
        won = np.flatnonzero(open_)[better]
        best[won] = value[better]
        shares[texts[won]], chosen[texts[won]] = share[better], mask[better]
    return shares, chosen


def detect_languages(
    documents: DataFrame, training: DataFrame, *, id_column: str = "doc_id", text: str = "text", language: str = "lang"
) -> DataFrame:
    """id, ``lang_pred``, ``score`` (its share), ``langs`` and ``shares`` of every text.

    Trained on all rows of ``training`` whose language is not null; at most
    MAX_LANGUAGES languages, more raise an error. Null texts and texts without a letter
    are "und" with score 0, as is everything when nothing could be learnt. Repeated
    rows are each returned, ties go to the language first in order, further columns
    are ignored, an empty table gives an empty result.
    """
    spark = documents.sparkSession
    model = LanguageModel.from_counts(trigram_counts(training, text=text, language=language))
    shared = spark.sparkContext.broadcast(model)  # BUCKETS * MAX_LANGUAGES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = text_bytes(batch.column(1))
            best, score, langs, parts = [], [], [], []
            for rows in slices(texts):
                own = texts[rows.start : rows.stop]
                w = words_of(own, rows, LETTERS, True)
                shares, chosen = infer(known, w)
                ascii_letter = np.zeros(len(w.buf) + 1, dtype=np.int64)
                np.cumsum((w.buf >= 97) & (w.buf <= 122), out=ascii_letter[1:])
                plain = ascii_letter[w.at[1:]] > ascii_letter[w.at[:-1]]
                for i in range(len(own)):
                    at = np.flatnonzero(chosen[i])
                    if not len(at) or not (plain[i] or any(c.isalpha() for c in own[i].decode())):
                        best.append("und")
                        score.append(0.0)
                        langs.append([])
                        parts.append([])
                        continue
                    at = at[np.argsort(-shares[i, at], kind="stable")]
                    best.append(known.names[at[0]])
                    score.append(float(min(1.0, shares[i, at[0]])))
                    langs.append([known.names[j] for j in at])
                    parts.append([round(float(v), 6) for v in shares[i, at]])
            yield pa.record_batch(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
                names=[id_column, "lang_pred", "score", "langs", "shares"],
            )

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text).mapInArrow(
        run, f"{id_column} {kind}, lang_pred string, score double, langs array<string>, shares array<double>"
    )
