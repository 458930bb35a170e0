"""Spelling variants: words of a corpus that differ by one letter, found in a frequency-vector trie.

The letters are dealt into ``GROUPS`` groups, and a word is the vector of how many
letters it has of each. In the trie, words branch by their counts of the first group,
then of the second, and so on. One inserted letter adds one to one count, a replaced one
also takes one from another (or changes nothing, inside a group). So a depth-first
search from the root needs a budget of one surplus and one deficit: it follows the
child with the word's own count, the one with a letter more while the surplus is there,
and the one with a letter less while the deficit is. The words in the leaves that it
reaches are compared letter by letter. Every pair is found once, from its shorter word,
or from the word whose changed letter group comes first (so a deficit is spent after
the surplus), or from the lesser word if the vectors are equal.

In Spark the trie is cut below its first levels: a word lies in the subtrie of its first
counts and visits the subtries that the search reaches. The cut goes down until no
subtrie has more than ``SUBTRIE`` words, and words that share a whole vector beyond that
number are dealt into pieces that every visitor sees. So a task holds one piece of a
subtrie and its visitors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import LOWER, slices, text_bytes

GROUPS = 16
SUBTRIE = 1 << 15
SLICE = 8 << 20
PAIRS = 1 << 19  # states and pairs worked on at a time
WIDE = 32  # longer words are compared one by one

# Of U+00C0 to U+00FF the UTF-8 bytes are 0xC3 and one from 0x80 to 0xBF; 0xC3 is never a second byte.
_LEAD = 0xC3
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), _LEAD]] = True


def _crc_table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1)
    return rest


_CRC = _crc_table()


def _checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, carried on from ``before``."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, rest = starts[order], before[order] ^ np.uint32(0xFFFFFFFF)
    long = int(np.count_nonzero(sizes > 4 * WIDE))
    top = int(sizes[order[long]]) if long < len(order) else 0
    within = np.searchsorted(-sizes[order], -np.arange(top), side="left")
    for j in range(top):
        some = slice(long, within[j])
        rest[some] = _CRC[(rest[some] ^ buf[at[some] + j]) & 255] ^ (rest[some] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = rest ^ np.uint32(0xFFFFFFFF)
    for i in order[:long]:
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _words_in(texts: list[bytes], ids: list, every: int, shortest: int) -> pa.Table:
    """(word, n) of texts: runs of letters, A-Z lower-cased, with the planted slips."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    lead = buf == _LEAD
    inside = _LETTER[buf]
    inside[1:] |= lead[:-1]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    twice = np.concatenate([[0], np.cumsum(lead)])
    letters = ends - starts - (twice[ends] - twice[starts])
    keep = letters >= shortest
    starts, ends, letters = starts[keep], ends[keep], letters[keep]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    named = np.array([i is not None for i in ids], dtype=bool)
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    check = _checksums(buf, starts, ends, prefix[owner])
    slip = (check % every == 0) & named[owner]
    slipped = []
    for s, e, h in zip(starts[slip], ends[slip], check[slip], strict=True):
        word = buf[s:e].tobytes().decode()
        place = int(h) % len(word)
        if len(word) > shortest:
            slipped.append(word[:place] + word[place + 1 :])
    starts, ends = starts[~slip], ends[~slip]
    sizes = ends - starts
    border = np.concatenate([[0], np.cumsum(sizes)])
    bytes_ = buf[np.arange(border[-1]) + np.repeat(starts - border[:-1], sizes)]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(border.astype(np.int64)), pa.py_buffer(bytes_)]
    ).cast(pa.large_string())
    words = pa.chunked_array([words, pa.array(slipped, pa.large_string())])
    counted = pc.value_counts(words.combine_chunks())
    return pa.table({"word": counted.field(0).cast(pa.string()), "n": counted.field(1)})


def word_counts(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    slip_every: int = 97,
    shortest: int = 5,
    least: int = 3,
) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur at least ``least`` times.

    Words are maximal runs of ASCII letters (lower-cased) and U+00C0 to U+00FF (as they
    are). A word whose CRC-32 with its document's id (``<id>:<word>``) is divisible by
    ``slip_every`` has lost one letter, at that number modulo its length. Null texts have
    no words, words of rows with a null id keep all letters; repeated rows count each time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for rows in slices(texts, SLICE):
                found = _words_in(texts[rows.start : rows.stop], ids[rows.start : rows.stop], slip_every, shortest)
                yield from found.to_batches(max_chunksize=1 << 16)

    counted = documents.select(id_column, text).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, sizes, vectors) of words: Latin-1 codes one after another, and counts by group."""
    flat = "".join(words.to_pylist()).encode("latin-1")
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer(flat, dtype=np.uint8)
    cell = np.repeat(np.arange(len(sizes)) * GROUPS, sizes) + letters % GROUPS
    return letters, sizes, np.bincount(cell, minlength=len(sizes) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _letters(batch.column(0))[2]
        packed = pa.array([v.tobytes() for v in vectors], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["word", "n", "vector"])


def _visits(depth: int):
    """Rows (key, word, n, resident): each word in its subtrie, and in those that it visits."""
    more = [[(0, 0)], *[[(i, 1)] for i in range(depth)]]
    more += [[(i, 1), (j, -1)] for i in range(depth) for j in range(i + 1, depth)]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(-1, GROUPS)[:, :depth]
            for resident, changes in [(True, []), *[(False, m) for m in more]]:
                moved = vectors.copy()
                for level, change in changes:
                    moved[:, level] += change
                there = np.flatnonzero(moved.min(axis=1) >= 0)
                key = pa.array([v.tobytes() for v in moved[there]], pa.binary())
                words, n = batch.column(0).take(pa.array(there)), batch.column(1).take(pa.array(there))
                yield pa.RecordBatch.from_arrays(
                    [key, words, n, pa.array(np.full(len(there), resident))], ["key", "word", "n", "resident"]
                )

    return visit


class _Trie:
    """Levels of a trie over count vectors: sorted (parent, count) codes, a node is its place there."""

    def __init__(self, vectors: np.ndarray):
        self.base = int(vectors.max(initial=0)) + 2
        node, self.levels = np.zeros(len(vectors), np.int64), []
        for level in range(GROUPS):
            codes, node = np.unique(node * self.base + vectors[:, level], return_inverse=True)
            self.levels.append(codes)
        self.words = np.argsort(node, kind="stable")
        self.first = np.searchsorted(node[self.words], np.arange(len(self.levels[-1]) + 1))

    def search(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(visitors, leaves, spent) that are reached, depth first over blocks of visitors.

        ``spent`` is 0, 1 after the surplus and 2 after the deficit too.
        """
        every = np.arange(len(vectors))
        stack = [(0, every, np.zeros(len(every), np.int64), np.zeros(len(every), np.int8))]
        while stack:
            level, who, node, spent = stack.pop()
            if level == GROUPS:
                yield who, node, spent
                continue
            if len(who) > PAIRS:
                for b in range(0, len(who), PAIRS):
                    stack.append((level, who[b : b + PAIRS], node[b : b + PAIRS], spent[b : b + PAIRS]))
                continue
            codes, found = self.levels[level], []
            for change, may in ((0, None), (1, spent == 0), (-1, spent == 1)):
                w, m, s = (who, node, spent) if may is None else (who[may], node[may], spent[may] + np.int8(1))
                count = vectors[w, level] + change
                code = m * self.base + count
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = (codes[place] == code) & (count >= 0) & (count < self.base)
                found.append((w[hit], place[hit], s[hit]))
            stack.append((level + 1, *[np.concatenate(x) for x in zip(*found, strict=True)]))


    def pairs(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(visitors, words, spent): the visitors with every word of the leaves that they reach."""
        for who, leaf, spent in self.search(vectors):
            many = self.first[leaf + 1] - self.first[leaf]
            upto = np.cumsum(many)
            begin = 0
            while begin < len(who):
                before = upto[begin] - many[begin]
                end = max(begin + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
                size = many[begin:end]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                words = self.words[np.repeat(self.first[leaf[begin:end]], size) + place]
                yield np.repeat(who[begin:end], size), words, np.repeat(spent[begin:end], size)
                begin = end


class _Words:
    """Words of a subtrie with their letters side by side, cut at ``WIDE``."""

    def __init__(self, words: pa.Array, n: pa.Array):
        self.words, self.n = words, n
        letters, self.sizes, self.vectors = _letters(words)
        begin = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(letters)) - np.repeat(begin, self.sizes)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.grid = np.zeros((len(self.sizes), WIDE), np.uint8)
        self.grid[owner[place < WIDE], place[place < WIDE]] = letters[place < WIDE]


def one_letter_apart(a: str, b: str) -> bool:
    """Whether ``b`` follows from ``a`` by one inserted or replaced letter."""
    if a == b or len(b) - len(a) not in (0, 1):
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def _verified(a: _Words, b: _Words, i: np.ndarray, j: np.ndarray, spent: np.ndarray) -> np.ndarray:
    """Which pairs differ by one letter; of pairs with equal vectors only those in order of letters."""
    good = np.zeros(len(i), dtype=bool)
    wide = b.sizes[j] > WIDE
    some = np.flatnonzero(~wide)
    x, y = a.grid[i[some]], b.grid[j[some]]
    apart = x != y
    place, row = apart.argmax(axis=1), np.arange(len(some))
    # Letters from the first difference on, moved by one where the word is longer.
    moved = ((x[:, :-1] != y[:, 1:]) & (np.arange(WIDE - 1) >= place[:, None])).any(axis=1)
    ordered = (spent[some] == 2) | (x[row, place] < y[row, place])
    good[some] = np.where(spent[some] == 1, ~moved, (apart.sum(axis=1) == 1) & ordered)
    for t in np.flatnonzero(wide):
        u, v = a.words[i[t]].as_py(), b.words[j[t]].as_py()
        good[t] = one_letter_apart(u, v) and (spent[t] > 0 or u < v)
    return good


def _near_in_subtrie(table: pa.Table) -> pa.Table:
    """(word, other, n) in both directions, of the near pairs of a subtrie's words and its visitors."""
    table = table.combine_chunks()
    mine = table["resident"]
    home, away = table.filter(mine), table.filter(pc.invert(mine))
    found = [[], [], []]
    if len(home) and len(away):
        a, b = (_Words(t["word"].combine_chunks(), t["n"].combine_chunks()) for t in (away, home))
        for i, j, spent in _Trie(b.vectors).pairs(a.vectors):
            good = _verified(a, b, i, j, spent)
            i, j = pa.array(i[good]), pa.array(j[good])
            for column, (x, y) in zip(found, ((a.words, b.words), (b.words, a.words), (b.n, a.n)), strict=True):
                one, other = (x.take(i), y.take(j)) if x is a.words else (x.take(j), y.take(i))
                column += [one, other]
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.table([pa.chunked_array(c, k) for c, k in zip(found, kinds, strict=True)], ["word", "other", "n"])


def near_words(words: DataFrame, subtrie: int = SUBTRIE) -> DataFrame:
    """(word, other, n): all pairs of distinct ``words`` (word, n) that differ by one letter, both ways.

    ``n`` is that of ``other``. Letters are those up to U+00FF.
    """
    vocabulary = materialise(words.select("word", "n").mapInArrow(_with_vectors, "word string, n long, vector binary"))
    depth, most = 0, None
    while depth < GROUPS and (most is None or most > subtrie):
        depth += 1
        sizes = vocabulary.groupBy(F.substring("vector", 1, 4 * depth).alias("key")).agg(F.count(F.lit(1)).alias("size"))
        most = sizes.agg(F.max("size")).first()[0] or 0
    visits = vocabulary.mapInArrow(_visits(depth), "key binary, word string, n long, resident boolean")
    if most > subtrie:
        # Words of one vector: pieces of bounded size, each of them for all visitors.
        pieces = sizes.select(F.col("key").alias("__key"), F.ceil(F.col("size") / subtrie).cast("int").alias("pieces"))
        visits = visits.join(pieces.where("pieces > 1"), F.col("key") == F.col("__key"), "left").drop("__key")
        last = F.coalesce("pieces", F.lit(1)) - 1
        own = F.pmod(F.xxhash64("word"), last + 1).cast("int")
        piece = F.explode(F.when(F.col("resident"), F.array(own)).otherwise(F.sequence(F.lit(0), last)))
        visits = visits.withColumn("piece", piece).drop("pieces")
    else:
        visits = visits.withColumn("piece", F.lit(0))
    return visits.groupBy("key", "piece").applyInArrow(_near_in_subtrie, "word string, other string, n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the last word that forms lead to.

    Each round doubles the steps; frequencies at least double along forms, so there are few.
    """
    state = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        state = materialise(
            state.join(further, F.col("root") == F.col("__word"), "left").select(
                "word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")
            )
        )
        moved = state.agg(F.max("moved")).first()[0]
        state = state.drop("moved")
        if not moved:
            return state


def spelling_variants(
    documents: DataFrame, *, id_column: str = "doc_id", text: str = "text", factor: int = 2, subtrie: int = SUBTRIE, **rules
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``word_counts`` (which takes ``rules``).

    Two words are near if one inserted, deleted or replaced letter turns one into the
    other. ``form`` is the near word of largest n, ties to the smallest in code-point
    order, if it has ``factor`` times the word's n or more (else null), and ``root`` is
    what following forms ends at, the word itself if it has none. Very long words are
    compared whole. Tables without such words, and empty ones, give an empty result.
    """
    words = materialise(word_counts(documents, id_column=id_column, text=text, **rules))
    near = near_words(words, subtrie).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best")
    )
    enough = -F.col("best.less") >= factor * F.col("n")
    joined = materialise(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(joined.where(F.col("form").isNotNull())).withColumnRenamed("word", "__word")
    return joined.join(roots, F.col("word") == F.col("__word"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
