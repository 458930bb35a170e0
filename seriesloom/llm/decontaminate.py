"""Benchmark decontamination: hashed windows of the benchmark against all training windows.

The benchmark's word windows are hashed, broadcast and looked up for every window
of every document; a hit counts only after its bytes have been compared. The
broadcast is bounded: benchmark windows are counted first, and a benchmark of more
than ``block_windows`` windows is handled in blocks of whole items, each with its
own broadcast and pass. Documents are never shuffled, so no key can be hot.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .text import ALNUM, window_hashes, word_slices, words_of

WINDOW = 13
BLOCK_WINDOWS = 1_000_000
SPANS, ITEMS, WORDS = "__spans", "__items", "__words"
_BITS = 20


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item_id, n_words, window): each window's words, lower-cased, joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, out = [], [], []
            names = batch.column(0).to_pylist()
            for w in word_slices(batch.column(1)):
                for i, n in enumerate(w.counts.tolist()):
                    words = [w.word_bytes(j).decode() for j in range(w.first[i], w.first[i + 1])]
                    size = min(n, window)
                    for j in range(n - size + 1 if n else 0):
                        ids.append(names[w.rows.start + i])
                        sizes.append(size)
                        out.append(" ".join(words[j : j + size]))
            yield pa.record_batch(
                [pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(out, pa.string())],
                names=["item_id", "n_words", "window"],
            )

    source = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return source.mapInArrow(cut, "item_id string, n_words int, window string")


class WindowSet:
    """Benchmark windows by hash, one sorted array per window length."""

    def __init__(self, rows: list[tuple[str | None, int, str]]):
        found: dict[tuple[int, bytes], list[str]] = {}
        for item, n, text in rows:
            own = found.setdefault((n, text.encode()), [])
            if item is not None and item not in own:
                own.append(item)
        self.by_length = {}
        for n in sorted({n for n, _ in found}):
            texts = [t for m, t in found if m == n]
            words = words_of(texts, range(len(texts)), ALNUM, False)
            hashes = window_hashes(words.hashes(), n)[words.first[:-1]]
            order = np.argsort(hashes)
            small = np.zeros(1 << _BITS, dtype=bool)
            small[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by_length[n] = (
                hashes[order], small, [texts[i] for i in order], [found[n, texts[i]] for i in order]
            )

    def hits(self, words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of every occurrence, each compared byte by byte."""
        hashes = words.hashes()
        spaced = None
        for n, (known, small, texts, items) in self.by_length.items():
            at = words.starts_of_windows(n)
            found = window_hashes(hashes, n)[at] if len(at) else np.zeros(0, dtype=np.uint64)
            near = small[(found >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, found = at[near], found[near]
            left = np.searchsorted(known, found)
            left[left == len(known)] = 0
            same = known[left] == found
            for i, j in zip(at[same].tolist(), left[same].tolist(), strict=True):
                if spaced is None:
                    spaced = _Spaced(words)
                h = known[j]
                while j < len(known) and known[j] == h:  # equal hashes stand side by side
                    if spaced.span(i, n) == texts[j]:
                        yield i, n, items[j]
                    j += 1


class _Spaced:
    """The words of a slice joined by single spaces."""

    def __init__(self, words):
        gap = np.ones(len(words.buf), dtype=bool)
        inside = np.zeros(len(words.buf) + 1, dtype=np.int32)
        np.add.at(inside, words.starts, 1)
        np.add.at(inside, words.ends, -1)
        gap = np.cumsum(inside[:-1]) == 0
        keep = ~gap
        keep[words.ends[words.ends < len(keep)]] = True
        text = np.where(gap, 32, words.buf).astype(np.uint8)
        self.bytes = text[keep].tobytes()
        self.at = np.concatenate(([0], np.cumsum(words.ends - words.starts + 1)))

    def span(self, first: int, n: int) -> bytes:
        return self.bytes[self.at[first] : self.at[first + n] - 1]


def _scan(documents: DataFrame, text: str, known, more: bool) -> DataFrame:
    """Add word count, hit spans (from, to, from, to, …) and item ids; ``more``: to earlier ones."""
    columns = documents.columns
    place = columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            counts: list[int] = []
            if more:
                spans = [list(s) for s in batch.column(batch.num_columns - 2).to_pylist()]
                items = [set(s) for s in batch.column(batch.num_columns - 1).to_pylist()]
            for w in word_slices(batch.column(place)):
                counts += w.counts.tolist()
                owners = None
                for first, n, names in table.hits(w):
                    owners = w.owner if owners is None else owners
                    i = int(owners[first])
                    begin = first - int(w.first[i])
                    own = spans[w.rows.start + i]
                    if own and own[-2] <= begin <= own[-1] and own[-1] <= begin + n:
                        own[-1] = begin + n  # windows come in order: overlapping ones grow together
                    else:
                        own += [begin, begin + n]
                    items[w.rows.start + i].update(names)
            kept = batch.columns[: batch.num_columns - 3] if more else batch.columns
            yield pa.record_batch(
                [*kept, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                 pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                names=[*(columns[:-3] if more else columns), WORDS, SPANS, ITEMS],
            )

    added = [
        T.StructField(WORDS, T.LongType()),
        T.StructField(SPANS, T.ArrayType(T.LongType())),
        T.StructField(ITEMS, T.ArrayType(T.StringType())),
    ]
    schema = documents.schema if more else T.StructType([*documents.schema.fields, *added])
    return documents.mapInArrow(search, schema)


def find_benchmark_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The documents with ``__words``, ``__spans`` (flat from-to pairs of words) and ``__items``.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and characters
    beyond ASCII. A benchmark item of fewer than ``window`` words, but not none, is
    one window. Null and empty texts have no words and no hits; items without words
    have no windows; items with a null id mark words but are not named. Repeated
    rows are each returned. Other columns pass through unchanged.
    """
    spark = documents.sparkSession
    windows = materialise(benchmark_windows(benchmark, window))
    total = windows.count()
    blocks = max(1, math.ceil(total / block_windows))
    part = F.pmod(F.xxhash64("n_words", "window"), F.lit(blocks))
    result = documents
    for b in range(blocks):
        # At most about block_windows rows of one window each, whatever the benchmark's size.
        rows = windows.where(part == b).select("item_id", "n_words", "window").collect()
        known = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in rows]))
        result = _scan(result, text, known, more=b > 0)
        if b < blocks - 1:
            result = materialise(result)
    return result


def _hit_words(flat: list[int]) -> int:
    """Number of words inside any of the spans."""
    covered, end = 0, -1
    for begin, stop in sorted(zip(flat[::2], flat[1::2], strict=True)):
        covered += max(0, stop - max(begin, end))
        end = max(end, stop)
    return covered


def contamination(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of scanned documents."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            hits = [_hit_words(s) for s in batch.column(2).to_pylist()]
            items = batch.column(3).to_pylist()
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(hits, pa.int64()),
                    pa.array([len(s) for s in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items]),
                    pa.array([h > 0 and 20 * h >= n for h, n in zip(hits, words, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = spans.schema["doc_id"].dataType.simpleString()
    return spans.select("doc_id", WORDS, SPANS, ITEMS).mapInArrow(
        digest,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )


def remove_contaminated(
    documents: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text: str = "text"
) -> DataFrame:
    """Training documents without benchmark content.

    ``mode="documents"`` drops documents of which at least a twentieth of the words
    is hit; ``mode="spans"`` keeps every document and cuts the hit words out, from
    the first to the last byte of each hit run. Columns are those of the input.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    found = find_benchmark_spans(documents, benchmark, text=text)
    columns = documents.columns
    place = columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(batch.num_columns - 3).to_pylist()
            spans = batch.column(batch.num_columns - 2).to_pylist()
            out = batch.columns[: len(columns)]
            if mode == "documents":
                hits = [_hit_words(s) for s in spans]
                keep = pa.array([not (h > 0 and 20 * h >= m) for h, m in zip(hits, n, strict=True)], pa.bool_())
                yield pa.record_batch(out, names=columns).filter(keep)
                continue
            texts = batch.column(place).to_pylist()
            out[place] = pa.array(
                [cut_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)], batch.schema.field(place).type
            )
            yield pa.record_batch(out, names=columns)

    return found.mapInArrow(clean, documents.schema)


def cut_spans(text: str, flat: list[int]) -> str:
    """The text without the bytes of the given word spans."""
    raw = text.encode()
    words = words_of([raw], range(1), ALNUM, True)
    keep = np.ones(len(raw), dtype=bool)
    for begin, stop in zip(flat[::2], flat[1::2], strict=True):
        keep[words.starts[begin] : words.ends[stop - 1]] = False
    return np.frombuffer(raw, dtype=np.uint8)[keep].tobytes().decode()
