"""Whole Arrow text columns to word and shingle hashes, in numpy passes over the bytes.

A word is a longest run of bytes other than ASCII white space; ASCII letters count as lower case.
Null counts as empty. Work goes over slices of about SLICE bytes (or one text), so memory stays
bounded by the longest text and never by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(salt))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE, 1 << max(0, n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        base, inverse = np.full(size, BASE, U), np.full(size, pow(BASE, -1, 1 << 64), U)
        base[0] = inverse[0] = 1
        _powers[size] = np.cumprod(base), np.cumprod(inverse)
    return _powers[size]


@dataclass
class Words:
    """Words of n texts, in order. first[i]:first[i+1] are text i's words."""

    n: int
    data: np.ndarray  # lower-cased bytes of all the texts
    raw: np.ndarray  # the bytes as they are
    offsets: np.ndarray  # n + 1 byte positions
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first) of every run of k words; a text of 1 to k-1 words has one shingle, of all of them."""
        size = len(self.hash)
        code = self.hash.copy()
        for t in range(1, k):
            code *= U(0xD6E8FEB86659FD93)
            if size > t:
                code[:-t] += np.where(self.doc[t:] == self.doc[:-t], self.hash[t:], U(0))
        whole = self.first[1:] - self.first[:-1]
        at = np.arange(size) - self.first[self.doc]
        keep = at <= np.maximum(whole[self.doc] - k, 0)
        doc = self.doc[keep]
        return mix(code[keep]), doc, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.n))]).astype(np.int64)


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of texts with about limit bytes."""
    column = as_text(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop - row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def split(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> Words:
    """Words of texts: longest runs of bytes for which apart is false."""
    n, size = len(offsets) - 1, len(data)
    raw, data = data, _LOWER[data]
    space = apart[data]
    before, after = np.ones(size, bool), np.ones(size, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    before[edges], after[edges - 1] = True, True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    base, inverse = power(size)
    prefix = np.zeros(size + 1, U)
    np.cumsum((data.astype(U) + U(1)) * base[:size], out=prefix[1:])
    code = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left").astype(np.int64)
    return Words(n, data, raw, offsets, start, end, code, doc, first)


def per_slice(column: pa.Array | pa.ChunkedArray, limit: int = SLICE, apart: np.ndarray = _SPACE) -> Iterator[tuple[int, Words]]:
    """(first row, its words) of slice after slice."""
    for row, _, data, offsets in slices(column, limit):
        yield row, split(data, offsets, apart)


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of that size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def spaced(w: Words) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, as bytes, and where each starts."""
    sizes = w.end - w.start
    start = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 32, np.uint8)
    at = places(sizes)
    out[np.repeat(start, sizes) + at] = w.data[np.repeat(w.start, sizes) + at]
    return out.tobytes(), start


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)
