"""Whole texts as NumPy arrays: bytes, words and 64-bit fingerprints of any span.

Words are maximal runs of bytes other than U+0020 and U+0009 to U+000D.  A null
text has no bytes.  Nothing here looks across the end of a document.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in groups of about so many bytes; a longer text is a group of its own.  Arrays take up to a hundred times as much.
GROUP_BYTES = 1 << 19


def settle_allocator() -> None:
    """Arrays of a group are given out of memory kept for it; those of 8 MB and more go back to the system once they are free.

    By default glibc lifts that limit to 32 MB, after which idle workers keep what their largest arrays took.
    """
    with contextlib.suppress(OSError, AttributeError):  # another C library
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD


settle_allocator()

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BYTE_VALUE = constants(256, 11)
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    return _powers(size)


class Spans:
    """Fingerprints of any spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        forward, self.back = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * forward[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def sliding(self, width: int) -> np.ndarray:
        """Of every span of ``width`` values."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n] + U64(width) * U64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """A group of documents: their bytes one after another, and where each begins (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # row of the batch that the first document is

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets, self.first)

    def words(self) -> Words:
        space = SPACE[self.data]
        n = len(space)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = space[:-1]
            after[:-1] = space[1:]
            begin, end = self.offsets[:-1], self.offsets[1:]
            full = end > begin
            before[begin[full]] = True
            after[end[full] - 1] = True
        np.logical_not(space, out=space)
        before &= space
        after &= space
        starts, ends = np.flatnonzero(before), np.flatnonzero(after) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.offsets))


@dataclass
class Words:
    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # first word of each document, and one more at the end

    def fingerprints(self) -> np.ndarray:
        return Spans(BYTE_VALUE[self.texts.data])(self.starts, self.ends)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every run of ``width`` words, repeats included, and offsets by document.

    A document of 1 to width - 1 words has one: all its words.
    """
    h = Spans(words.fingerprints())
    counts = np.diff(words.offsets)
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(each)])
    starts = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - words.offsets[:-1], each)
    ends = np.minimum(starts + width, np.repeat(words.offsets[1:], each))
    return h(starts, ends), offsets


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each document."""
    values, offsets = shingles(words, width)
    return [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def text_groups(column: pa.Array | pa.ChunkedArray, group_bytes: int = GROUP_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow column in groups of bounded size, each text whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + group_bytes, "right")) - 1)
        j = min(j, n)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What SQL's xxhash64 gives for one BIGINT, as signed 64-bit numbers."""
    p1, p2, p3, p4, p5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotl = lambda v, r: (v << U64(r)) | (v >> U64(64 - r))
    v = np.asarray(x, np.int64).view(U64)
    h = np.full(len(v), (seed + int(p5) + 8) & ((1 << 64) - 1), U64)
    h ^= rotl(v * p2, 31) * p1
    h = rotl(h, 27) * p1 + p4
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    h ^= h >> U64(32)
    return h.view(np.int64)
