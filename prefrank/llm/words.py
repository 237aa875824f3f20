"""Words, shingles and sentences of a batch of texts as numpy arrays.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII characters, with A-Z
lower-cased. Hashes of all words of a batch come from one running sum of
``code(byte) * B**position`` modulo 2**64, so no Python loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Text handled at once: its arrays take some 80 bytes a byte of text, and a worker keeps the tables of powers.
BATCH_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _fold_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return table


FOLD = _fold_table()
_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
_CODE[0] = 0
_PLACE = mix(np.arange(1, 1 + SHINGLE * 4, dtype=_U)) | _U(1)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BATCH_BYTES + 1)
        _powers = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, _BASE, _U)])
        _inverse = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, pow(_BASE, -1, 1 << 64), _U)])
    return _powers, _inverse


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null is an empty text."""
    array = array.fill_null("").cast(pa.large_string())
    _, places, content = array.buffers()
    offsets = np.frombuffer(places, np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(array: pa.Array, limit: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Cut a batch so that a slice holds about ``limit`` bytes, or one longer text."""
    lengths = np.diff(utf8(array)[1])
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > limit:
            yield array.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(array):
        yield array.slice(begin)


class Words:
    """All words of a batch: ``doc``, byte range ``first:last`` and 64-bit ``hash`` of each."""

    def __init__(self, array: pa.Array):
        self.data, self.offsets = utf8(array)
        n, self.docs = len(self.data), len(array)
        self.folded = FOLD[self.data]
        inside = self.folded != 0
        starts = np.zeros(n + 1, bool)
        starts[self.offsets] = True
        before = np.r_[False, inside[:-1]] & ~starts[:-1] if n else inside
        after = np.r_[inside[1:], False] & ~starts[1:] if n else inside
        self.first = np.flatnonzero(inside & ~before)
        self.last = np.flatnonzero(inside & ~after) + 1
        powers, self._inverse = _grown(n)
        self._sums = np.zeros(n + 1, _U)
        np.cumsum(_CODE[self.folded] * powers[:n], out=self._sums[1:])
        self.hash = self.part(self.first, self.last)
        self.doc = np.searchsorted(self.offsets, self.first, side="right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(self.docs + 1))

    def part(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the word bytes in each range."""
        return mix((self._sums[last] - self._sums[first]) * self._inverse[first])

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than ``size`` bytes, and the hash of their first ``size`` bytes."""
        longer = self.last - self.first > size
        first = self.first[longer]
        return longer, self.part(first, first + size)

    def shingles(self, size: int = SHINGLE, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``size`` words inside a text.

        A text of 1 to ``size - 1`` words has one shingle, all its words. ``bounds`` (first words
        of parts, then the number of words) keeps runs inside smaller parts than texts.
        """
        n = len(self.hash)
        if bounds is None:
            bounds, part = self.bounds, self.doc
        else:
            part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end = bounds[1:][part]
        total, at = np.zeros(n, _U), np.arange(n)
        for j in range(size):
            there = at + j < end
            total[there] += self.hash[at[there] + j] * _PLACE[j]
        keep = (at + size <= end) | (at == bounds[:-1][part])
        return at[keep], mix(total[keep])

    def lines(self) -> np.ndarray:
        """First word of every line that has a word, then the number of words."""
        mark = np.cumsum(self.data == 10)[self.first] if len(self.first) else self.first
        new = (mark[1:] != mark[:-1]) | (self.doc[1:] != self.doc[:-1])
        return np.r_[np.flatnonzero(np.r_[True, new]), len(mark)] if len(mark) else np.zeros(1, np.int64)

    def chars(self) -> np.ndarray:
        """Code points before each byte of the batch."""
        return np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]

