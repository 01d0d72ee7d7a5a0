"""Vectorised tokenising of Arrow text columns: whole blocks of documents as byte arrays.

A block is a run of whole documents of about BLOCK bytes (a longer document is
a block of its own), so that memory doesn't depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block(NamedTuple):
    first: int  # index of the first document in the column
    data: np.ndarray  # UTF-8 bytes
    bounds: np.ndarray  # document i is data[bounds[i]:bounds[i + 1]]


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """Nulls are empty documents."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        arr = pc.fill_null(part.cast(pa.large_string()), "")
        first = 0
        offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
        while first < len(arr):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last


class _Powers:
    def __init__(self, base: np.uint64) -> None:
        self.bases = ("up", base), ("down", np.uint64(pow(int(base), -1, 1 << 64)))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in self.bases:
                    t = np.full(size, base, np.uint64)
                    t[0] = 1
                    setattr(self, name, np.multiply.accumulate(t))
        return self.up, self.down


POWERS = _Powers(_BASE)
OTHER_POWERS = _Powers(np.uint64(0xC6BC279692B5C323))  # for fingerprints that don't depend on the first


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = BLOCK, powers: _Powers = POWERS) -> np.ndarray:
    """64-bit fingerprints of data[start:end] for spans in order of start and of end."""
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + limit, "right")))
            lo, hi = int(start[i]), int(end[j - 1])
            up, down = powers.get(hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _BASE)
            i = j
    return out


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # words of document i are first[i]:first[i + 1]
    hash: np.ndarray


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes other than space and 0x09 to 0x0D, A-Z lower-cased by default; none crosses a document."""
    n = len(data)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, bounds), spans_hash(LOWER[data] if lower else data, start, end))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of k-word shingles in order, and where each document's begin.

    A document of 1 to k-1 words has one shingle, its whole word sequence; one without words has none.
    """
    count = np.diff(w.first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], made)  # the shingle's first word
    left = np.repeat(np.minimum(count, k), made)  # its number of words
    h = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    total = left.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = mix(total * _BASE + np.where(j < left, h[at + j], np.uint64(0)))
    return total, first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order."""
    v = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        v[a:b].sort()
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    return v[new], np.concatenate([[0], np.cumsum(new)])[first]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
