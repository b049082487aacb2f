"""Words, lines and shingles of whole Arrow string columns as numpy arrays over their UTF-8 bytes.

White space is 0x20 and 0x09-0x0D. None of these bytes occurs inside a multi-byte character,
so cutting bytes cuts code points at the same places. Hashes are 64-bit: each byte's random number times
an odd power of its place, summed, then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1024), _ODD, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Rows first..last of a column: their bytes and where each text begins (n + 1 offsets)."""

    first: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1


def chunks(column: pa.Array, size: int = CHUNK_BYTES, step: int = 1) -> Iterator[Texts]:
    """The column cut between rows (step: at multiples of so many rows) into runs of about `size` bytes. Null is the empty text."""
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = min(int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1, first + 8192)
        last = min(max(last - (last - first) % step, first + step), len(column))
        yield Texts(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Pieces:
    """Words or lines: begin and end byte, owner text, 64-bit hash."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.begin)


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin:end] for each piece; pieces are in order, don't overlap and aren't empty."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    starts = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(starts, size)
    value = _BYTE[data[inside + np.repeat(begin, size)]] * powers(int(size.max()))[inside]
    return mix(np.add.reduceat(value, starts) + size.astype(np.uint64))


def words(t: Texts, hashed: bool = True, space: np.ndarray = SPACE) -> Pieces:
    """Runs of bytes that aren't `space`."""
    data, n = t.data, len(t.data)
    inside = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[t.at] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    doc = np.searchsorted(t.at, begin, side="right") - 1
    return Pieces(begin, end, doc, _hashes(data, begin, end) if hashed else np.zeros(0, np.uint64))


def lines(t: Texts, w: Pieces) -> Pieces:
    """The \\n-split lines that hold a word."""
    n = len(t.data)
    begin = np.unique(np.concatenate([t.at[:-1], np.flatnonzero(t.data == 10) + 1]))
    begin = begin[begin < n]
    end = np.append(begin[1:], n) if len(begin) else begin
    end = end - (t.data[end - 1] == 10) if len(end) else end
    has = np.searchsorted(w.begin, end) > np.searchsorted(w.begin, begin)
    begin, end = begin[has], end[has]
    doc = np.searchsorted(t.at, begin, side="right") - 1
    return Pieces(begin, end, doc, _hashes(t.data, begin, end))


def shingles(w: Pieces, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of `size` words; a text of fewer words, but not none, has one of all its words."""
    count = np.bincount(w.doc, minlength=n_docs)
    doc, h = windows(w, size)
    small = np.flatnonzero((count > 0) & (count < size))
    if len(small):
        at = np.cumsum(count) - count
        total = np.zeros(len(small), np.uint64)
        for k in range(size - 1):
            has = count[small] > k
            total[has] += w.hash[at[small[has]] + k] * powers(size + 1)[k + 1]
        doc, h = np.concatenate([doc, small]), np.concatenate([h, mix(total + count[small].astype(np.uint64))])
    return doc, h


def windows(w: Pieces, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of `size` words, in order."""
    m = len(w) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(size):
        h += w.hash[k : k + m] * powers(size + 1)[k + 1]
    whole = w.doc[:m] == w.doc[size - 1 :]
    return w.doc[:m][whole], mix(h + np.uint64(size))[whole]


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) and how often each occurs, in order of doc, then hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def packed(t: Texts, w: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All words, A-Z lower-cased, each after one space, and a last space; and where each word's space is."""
    size = w.end - w.begin
    starts = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()) + 1, 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(starts, size) + 1 + inside] = _LOWER[t.data[np.repeat(w.begin, size) + inside]]
    return out, starts


def lowered(t: Texts) -> Texts:
    return Texts(t.first, _LOWER[t.data], t.at)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and at their end this worker's freed memory goes back to the system: workers outlive tasks, and stages that come after need it."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)
