"""Words, hashes and windows of many texts at once, with NumPy on raw UTF-8 bytes.

All word rules used here are byte rules: a byte of 0x80 or more belongs to a
non-ASCII character, so classes such as "letters, digits and everything beyond
ASCII" can be tested byte by byte. Texts are joined with a separator byte and cut
into slices of bounded size, so a task needs memory for one slice, or for its
longest single text if that is larger, and never for a whole partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 17
KEPT_POWERS = 1 << 18
_U = np.uint64


def byte_class(pattern_bytes: bytes, high: bool = True) -> np.ndarray:
    """Table of the bytes that belong to words: the given ASCII ones, and all beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    table[128:] = high
    return table


#: Words of letters, digits and characters beyond ASCII (after lower-casing A-Z).
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Words between ASCII white space.
VISIBLE = ~byte_class(b" \t\n\x0b\x0c\r", high=False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def salted(values, salt: int) -> np.ndarray:
    return mix(np.asarray(values, dtype=_U) + _U((salt * 0x9E3779B97F4A7C15) % 2**64))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, the first ``KEPT_POWERS`` of them kept."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > KEPT_POWERS:  # a single long text; the worker goes on without its table
            return self._powers(self.base, n), self._powers(self.inverse, n)
        if len(self.up) < n:
            size = min(KEPT_POWERS, max(n, 2 * len(self.up)))
            self.up, self.down = self._powers(self.base, size), self._powers(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        return np.cumprod(steps, dtype=_U)


_LETTERS, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
_LETTERS2, _WORDS2 = Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB)
_CODES = mix(np.arange(1, 257, dtype=_U))


def _spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash of every span, from differences of one running sum."""
    up, down = powers.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def window_hashes(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (runs over text borders included)."""
    if len(hashes) < k:
        return np.zeros(0, dtype=_U)
    at = np.arange(len(hashes) - k + 1)
    return _spans(hashes, at, at + k, _WORDS2 if second else _WORDS)


@dataclass
class Words:
    """Words of a slice of texts.

    ``buf`` holds the bytes of all texts with a line feed after each; text ``i``
    is ``buf[at[i] : at[i + 1] - 1]`` and its words are ``first[i] : first[i + 1]``.
    """

    rows: range
    buf: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, second: bool = False) -> np.ndarray:
        codes = _CODES[self.buf]
        return _spans(codes, self.starts, self.ends, _LETTERS2 if second else _LETTERS)

    def span_hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of arbitrary byte spans of the slice."""
        return _spans(_CODES[self.buf], begins, ends, _LETTERS)

    def starts_of_windows(self, k: int) -> np.ndarray:
        """Index of the first word of each window of ``k`` words inside one text."""
        room = np.maximum(self.counts - k + 1, 0)
        begin = np.cumsum(room) - room
        return np.arange(room.sum()) - np.repeat(begin, room) + np.repeat(self.first[:-1], room)

    def word_bytes(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def words_of(texts: list[bytes], rows: range, table: np.ndarray, lower: bool) -> Words:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    inside = np.zeros(len(buf) + 1, dtype=np.int8)
    inside[1:] = table[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(rows, buf, at, starts, ends, np.searchsorted(starts, at))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], size: int = SLICE_BYTES) -> Iterator[range]:
    """Consecutive rows of at most ``size`` bytes together, or a single longer row."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > size:
            yield range(begin, i)
            begin, total = i, 0
        total += len(t) + 1
    if texts:
        yield range(begin, len(texts))


def word_slices(
    column: pa.Array, table: np.ndarray = ALNUM, lower: bool = True, size: int = SLICE_BYTES
) -> Iterator[Words]:
    """Words of all texts of an Arrow column, slice by slice; only one slice is taken out at a time."""
    if not len(column):
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin = 0
    while begin < len(upto):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + size, side="right")))
        yield words_of(text_bytes(column.slice(begin, end - begin)), range(begin, end), table, lower)
        begin = end


def sequence_hash(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The first of ``sequence_hashes``, from the hashes of the words."""
    return _spans(hashes, words.first[:-1], words.first[1:], _WORDS)


def sequence_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's word sequence."""
    out = []
    for second in (False, True):
        h = words.hashes(second)
        out.append(_spans(h, words.first[:-1], words.first[1:], _WORDS2 if second else _WORDS))
    return out[0], out[1]


def ragged(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """List array of consecutive runs of ``values``; ``ends`` starts with 0."""
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values, kind)).cast(
        pa.list_(kind)
    )


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=_U).view(np.int64)
