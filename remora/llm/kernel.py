"""Vectorised text kernels on numpy: hashing, tokens and sliding minima over many documents at once.

Texts are handled as UTF-8 bytes. A block is a run of whole documents laid end to end in one
byte array, with the documents' offsets beside it; no result crosses a document's border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[str, np.ndarray] = {}

#: Bytes of text that are handled at once. A longer document makes a block of its own.
BLOCK = 1 << 21


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans: True where a byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words are runs of anything but blanks.
BLANK_SPLIT = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of digits, letters and anything beyond ASCII, after lower-casing A-Z.
ALNUM_SPLIT = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n + 1:
        size = max(n + 1, BLOCK + 1)
        with np.errstate(over="ignore"):
            for name, factor in (("p", _BASE), ("i", _INVERSE)):
                steps = np.full(size, U(factor))
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"][: n + 1], _POWERS["i"][: n + 1]


class Hasher:
    """Hashes of any byte range of a block, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[data] * up[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix(raw + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def rolling(self, width: int) -> np.ndarray:
        """Hashes of all ranges of this width."""
        with np.errstate(over="ignore"):
            raw = (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]
            return mix(raw)


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    _, at, data = column.buffers()
    if not n:
        return
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of a block: byte ranges, documents, positions in the document, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        n = len(offsets) - 1
        data = LOWER[data] if lower else data
        inside = table[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        before[offsets] = False  # a document's first byte has none before it
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = inside
        after[offsets] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.data = data
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(self.count, out=self.first[1:])
        self.at = np.arange(len(self.start)) - self.first[self.doc]
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = Hasher(self.data).spans(self.start, self.end)
        return self._hash

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words inside a document."""
        total = len(self.start)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found = gram_hash(self.hash, n)
        first = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        return first, found[first]


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes."""
    total = len(words) - n + 1
    found = np.zeros(max(0, total), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            found = found * U(_BASE) + words[i : i + total]
    return mix(found + U(n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of this width, by doubling."""
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in the row) for rows of these lengths."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
