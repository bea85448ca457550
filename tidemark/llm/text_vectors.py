"""Whole texts as numpy vectors: words, their hashes and positions, for Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 21

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

#: ASCII white space, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All ASCII but letters and digits: what separates words where punctuation doesn't count.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(i).isalnum() for i in range(128)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@dataclass
class Chunk:
    """Some rows of a batch: the bytes of their texts one after the other, and where each begins and the last ends."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """texts (a string array; null counts as empty) in runs of rows with about so many bytes at most."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield Chunk(lo, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


class Hashes:
    """Hashes of any span of some bytes: prefix sums of byte values times powers of a radix, modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        power = np.full(n + 1, _RADIX)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=self.sums[1:])
        self.back = power
        self.back[:] = _INVERSE
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def words(chunk: Chunk, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words of a chunk. gaps: by byte value, whether it stands between words."""
    data, bounds = chunk.data, chunk.bounds
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = edge[:-1].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def shingles(chunk: Chunk, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of the word shingles of each text, lower-cased, with repeats.

    A text with fewer words than size has its whole sequence as one; a text without words has none.
    """
    starts, ends, rows = words(chunk)
    if not len(starts):
        return rows, np.zeros(0, np.uint64)
    h = Hashes(LOWER[chunk.data]).of(starts, ends)
    n = np.bincount(rows, minlength=chunk.rows)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    short = np.flatnonzero((n > 0) & (n < size))
    at = np.flatnonzero(np.arange(len(h)) + size <= (first + n)[rows])
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mixed(out * _RADIX + h[at + k])
    if len(short):
        few = n[short].astype(np.uint64)
        for k in range(size - 1):
            more = n[short] > k
            few[more] = mixed(few[more] * _RADIX + h[first[short][more] + k])
        at, out = np.concatenate([at, first[short]]), np.concatenate([out, few])
    return rows[at], out
