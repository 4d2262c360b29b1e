"""Words and hashes of whole texts, computed over Arrow string buffers with numpy.

All functions work on the UTF-8 bytes of many documents at once. Slices bound the temporaries; a single
document longer than a slice is a slice of its own, so texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
P = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES, SLICE_DOCS = 1 << 21, 1 << 15

#: Separators of `[^\x20\x09-\x0D]+` words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def _table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


NOT_SPACE = ~_table(SPACES)
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words: digits, a-z, and all of a non-ASCII character.
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U64)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of documents of about `limit` bytes."""
    raw, off = buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + SLICE_DOCS, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    data: np.ndarray  # bytes of the slice
    off: np.ndarray  # document offsets in bytes
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past the last
    first: np.ndarray  # index of each document's first word, and the total

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.per_doc)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(data: np.ndarray, off: np.ndarray, members: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of member bytes; no word spans two documents."""
    inside = members[data]
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, off, none, none, np.zeros(len(off), np.int64))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = off[off < n]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = off[(off > 0)] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; words over 64 bytes go through xxhash."""
    n = len(w.start)
    if n == 0:
        return np.zeros(0, U64)
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    length = (w.end - w.start).astype(np.int64)
    h = length.astype(U64) * U64(P)
    idx, k = np.arange(n), 0
    while len(idx):
        at = w.start[idx] + 8 * k
        left = np.minimum(length[idx] - 8 * k, 8)
        h[idx] = mix(h[idx] ^ (view[at] & _MASKS[left]))
        k += 1
        if k == 8:
            break
        idx = idx[length[idx] > 8 * k]
    for i in np.flatnonzero(length > 64):
        h[i] = xxhash.xxh3_64_intdigest(w.text(i))
    return h


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values, by doubling: O(log n) passes."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, size, power, m = None, 0, h, 1
    while n:
        if n & 1:
            if out is None:
                out, size = power, m
            else:
                keep = len(h) - size - m + 1
                out = out[:keep] * U64(pow(P, m, 1 << 64)) + power[size : size + keep]
                size += m
        n >>= 1
        if n:
            power = power[:-m] * U64(pow(P, m, 1 << 64)) + power[m:]
            m *= 2
    return mix(out)


def per_doc_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of per-byte (or per-word) values in each document."""
    kind = np.int32 if values.dtype == bool and len(values) < 1 << 31 else None
    total = np.concatenate([[0], np.cumsum(values, dtype=kind)])
    return total[off[1:]] - total[off[:-1]]


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64-bit hashes."""
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
