"""Vectorised text primitives over Arrow string columns.

Words are runs of bytes of one class; every class used here ends at ASCII characters only, so runs of UTF-8
bytes and runs of code points are the same. Word hashes are 64-bit polynomial hashes over random byte values,
taken from prefix sums, so no Python code runs per word. Work is cut into slices of a few MB; memory depends on
the longest single text, not on the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SECOND_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1


def _class(ranges: list[tuple[int, int]], inside: bool) -> np.ndarray:
    lut = np.full(256, not inside)
    for low, high in ranges:
        lut[low : high + 1] = inside
    return lut


#: ASCII white space ends a word.
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)], False)
#: Digits, a-z and everything beyond ASCII form words; used on lower-cased text.
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(10, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Texts:
    """The bytes of some texts: data, and begin/end of each text in data."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        if column.null_count or column.offset:
            column = pa.concat_arrays([column])
        offsets = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=column.offset * 8)
        raw = column.buffers()[2]
        low, high = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(raw, np.uint8, count=high - low, offset=low) if raw is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        self.n = len(column)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """start, end: byte positions of each word; doc: index of its text; first: index of each text's first word (n + 1 values)."""

    def __init__(self, texts: Texts, word_bytes: np.ndarray, lower: bool = False):
        self.texts = texts
        data = LOWER[texts.data] if lower else texts.data
        self.data = data
        inside = word_bytes[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = texts.offsets[:-1] < texts.offsets[1:]
        at = texts.offsets[:-1][filled]
        begins[at] = inside[at]
        at = texts.offsets[1:][filled] - 1
        ends[at] = inside[at]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, texts.offsets)
        self.doc = np.repeat(np.arange(texts.n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each of some ascending, disjoint byte spans; second: another, independent one."""
    values = _SECOND_VALUE if second else _BYTE_VALUE
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + HASH_BYTES, "right")))
        low, high = int(start[a]), int(end[b - 1])
        up, down = powers(_BASE, high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=total[1:])
        s, e = start[a:b] - low, end[a:b] - low
        out[a:b] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        a = b
    return mix(out)


def prefix(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums for range_hash."""
    up, _ = powers(_WORD_BASE, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return total


def range_hash(total: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words low..high-1, the same wherever that sequence stands."""
    _, down = powers(_WORD_BASE, len(total))
    return mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))


def windows(words: Words, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word indices) and hashes of all k-word windows that stay within one text."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    return at, range_hash(total, at, at + k)


class Lines:
    """Lines between newlines: start, end; the same without outer ASCII white space: low, high; first: index of each text's first line."""

    def __init__(self, texts: Texts):
        breaks = np.flatnonzero(texts.data == 10)
        self.start = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]))
        self.end = np.sort(np.concatenate([breaks, texts.offsets[1:]]))
        self.first = np.arange(texts.n + 1) + np.searchsorted(breaks, texts.offsets)
        self.doc = np.repeat(np.arange(texts.n), np.diff(self.first))
        solid = np.flatnonzero(SPACED[texts.data])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        self.blank = a == b
        padded = np.append(solid, 0)
        self.low = np.where(self.blank, self.start, padded[a])
        self.high = np.where(self.blank, self.start, padded[b - 1] + 1)


def code_points(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Code points in each byte span."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total[high] - total[low]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text each; a longer text stands alone."""
    lengths = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(pa.concat_arrays([lengths]).buffers()[1], np.int64, count=len(lengths) + 1)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
