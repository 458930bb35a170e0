"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Every text is measured once. Each rule votes good (1) or bad (0) where
its condition holds and abstains (-1) elsewhere. Spark counts how often each pattern of votes
occurs (at most 2 to the number of rules, however many documents there are), and
expectation-maximisation over those counts estimates how often each rule is right. A document is kept when the
posterior probability of "good" under its votes reaches one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import VISIBLE, window_hashes, word_slices

REPEAT = 5
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_stops", "n_odd_ends",
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[192:] = True  # first byte of a character beyond ASCII
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def measure(words) -> dict[str, np.ndarray]:
    """All measures of the texts of a slice."""
    n, hashes, buf, at = len(words.counts), words.hashes(), words.buf, words.at
    out = {"n_words": words.counts.astype(np.int64)}
    # Code points: bytes that do not continue a character.
    out["word_chars"] = _sums(VISIBLE[buf] & ((buf & 0xC0) != 0x80), at)
    out["n_symbols"] = _sums(_SYMBOL[buf], at)
    out["n_upper"] = _sums(_UPPER[buf], at)
    out["n_letters"] = _sums(_LETTER[buf], at)
    out["n_stops"] = _sums(_STOP[buf], at)

    # Lines with a word: hash of the line's bytes, equal to an earlier one of the same text.
    stops = np.flatnonzero(buf == 10)
    begins = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    has_word = np.searchsorted(words.starts, stops) > np.searchsorted(words.starts, begins)
    begins, stops = begins[has_word], stops[has_word]
    raw = words.span_hashes(begins, stops)
    owner = np.searchsorted(at, begins, side="right") - 1
    out["n_lines"] = np.bincount(owner, minlength=n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(owner[_repeats(owner, raw)], minlength=n).astype(np.int64)

    # Words inside 5-word windows that occur twice or more in the text.
    starts = words.starts_of_windows(REPEAT)
    covered = np.zeros(len(hashes) + 1, dtype=np.int32)
    if len(starts):
        value = window_hashes(hashes, REPEAT)[starts]
        hit = starts[_repeats(words.owner[starts], value, first=True)]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + REPEAT, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = _sums(inside, words.first)

    final = buf[words.ends - 1] if len(words.ends) else buf[:0]
    odd = ~(_LETTER[final] | (final >= 128) | ((final >= 48) & (final <= 57)) | (final == 46) | (final == 44))
    out["n_odd_ends"] = _sums(odd, words.first)
    return out


def _repeats(owner: np.ndarray, value: np.ndarray, first: bool = False) -> np.ndarray:
    """Which entries equal another one of the same owner: later ones, or with ``first`` all."""
    key = value ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = same
    if first:
        out[order[:-1]] |= same
    return out


def text_measures(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and all MEASURES (long) of every text; null and empty texts measure 0 throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(w) for w in word_slices(batch.column(1), VISIBLE, lower=False)]
            if not parts:
                continue
            yield pa.record_batch(
                [batch.column(0), *[pa.array(np.concatenate([p[m] for p in parts]), pa.int64()) for m in MEASURES]],
                names=[id_column, *MEASURES],
            )

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text).mapInArrow(
        run, f"{id_column} {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    )


@dataclass(frozen=True)
class Rule:
    """Votes ``vote`` (0 bad, 1 good) where the condition holds, else abstains."""

    name: str
    vote: int
    when: str


#: Integer comparisons only, so that every engine and platform votes alike. A text that lacks one
#: fault may have another, so passing a single test is no vote for good: only "prose" and
#: "original" vote good, and they look at several measures.
RULES = (
    Rule("symbols", 0, "10 * n_symbols > word_chars"),
    Rule("capitals", 0, "2 * n_upper > n_letters and n_letters > 20"),
    Rule("repeats", 0, "10 * n_repeat_words > n_words"),
    Rule("lines", 0, "3 * n_dup_lines > n_lines"),
    Rule("word_length", 0, "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("word_ends", 0, "4 * n_odd_ends > n_words"),
    Rule("no_sentences", 0, "n_words > 60 and 100 * n_stops < n_words"),
    Rule("prose", 1, "n_words >= 10 and 50 * n_symbols < word_chars and 5 * n_upper < n_letters "
                     "and 20 * n_odd_ends < n_words and n_stops > 0"),
    Rule("original", 1, "n_words >= 20 and 50 * n_repeat_words < n_words and 20 * n_dup_lines < n_lines "
                        "and 10 * n_symbols < word_chars and 20 * n_odd_ends < n_words"),
)


def votes(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.when(F.expr(r.when), r.vote).otherwise(-1) for r in rules])


@dataclass
class LabelModel:
    """P(good) and, per rule, the probability that it is right when it votes."""

    prior: float
    accuracy: np.ndarray

    @classmethod
    def fit(
        cls, patterns: np.ndarray, counts: np.ndarray, *, prior: float = 0.5, accuracy: float = 0.8,
        rounds: int = 200, tolerance: float = 1e-9,
    ) -> LabelModel:
        """EM over vote patterns and how often each occurs; an abstention says nothing.

        The class balance ``prior`` is given, not estimated: with mostly good texts an
        estimated one would grow until every vote for bad counts as an error. Accuracies
        are smoothed with ten rows at the start value and never fall below chance, so
        the two classes cannot swap.
        """
        model = cls(prior, np.full(patterns.shape[1], accuracy))
        voted = patterns >= 0
        for _ in range(rounds):
            good = model.posterior(patterns)
            right = np.where(patterns == 1, good[:, None], 1 - good[:, None]) * voted
            share = (right * counts[:, None]).sum(0) + 10 * accuracy
            new = cls(prior, np.clip(share / ((voted * counts[:, None]).sum(0) + 10), 0.5, 0.999))
            moved = np.abs(new.accuracy - model.accuracy).max(initial=0.0)
            model = new
            if moved < tolerance:
                break
        return model

    @property
    def weights(self) -> np.ndarray:
        """Log odds that a vote of each rule adds for its side."""
        return np.log(self.accuracy / (1 - self.accuracy))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        side = np.where(patterns < 0, 0, 2 * patterns - 1)
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + side @ self.weights)))


def weak_quality(
    documents: DataFrame, *, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, min_words: int = 10
) -> DataFrame:
    """doc_id, measures, vote array, posterior of "good", base_failed and kept.

    Texts of fewer than ``min_words`` words, or with over a fifth of their words in
    repeated windows, fail outright. Null and empty texts have no words, so they
    fail. Ties, repeated rows and further columns make no difference: each row is
    measured by itself. An empty table gives an empty result.
    """
    measured = materialise(text_measures(documents).withColumn("votes", votes(rules)))
    table = measured.groupBy("votes").count().collect()  # at most 2 ** len(rules) rows
    patterns = np.array([r["votes"] for r in table], dtype=int).reshape(-1, len(rules))
    counts = np.array([r["count"] for r in table], dtype=float)
    model = LabelModel.fit(patterns, counts)
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for i, weight in enumerate(model.weights.tolist()):
        vote = F.col("votes")[i]
        odds = odds + F.when(vote == 1, weight).when(vote == 0, -weight).otherwise(0.0)

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumns(
        {"base_failed": failed, "kept": ~failed & (F.col("posterior") >= threshold)}
    )
