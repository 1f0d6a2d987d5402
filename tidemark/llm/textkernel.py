"""Vectorised word and hash kernels over the UTF-8 bytes of Arrow string columns.

Every kernel works on slices of a few MB whatever the batch, so a worker's memory follows the longest single text and
not the batch. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hash and the multipliers of the finaliser (splitmix64).
BASE = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
SLICE_BYTES = 1 << 20
BLOCK = 1 << 17

#: The six ASCII blanks that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are not ASCII letters or digits; all of UTF-8's multi-byte characters count as letters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
PUNCTUATION[ord("0") : ord("9") + 1] = PUNCTUATION[ord("A") : ord("Z") + 1] = PUNCTUATION[ord("a") : ord("z") + 1] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; wraps modulo 2**64."""
    x = x ^ (x >> U64(30))
    x *= MIX_1
    x ^= x >> U64(27)
    x *= MIX_2
    x ^= x >> U64(31)
    return x


def seed(i: int) -> np.uint64:
    return U64((0x632BE59BD9B4E019 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64 for k up to n at least."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(BLOCK * 2, 1 << int(n).bit_length())
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size + 1, b, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for ordered, disjoint segments. Works in blocks of about BLOCK values."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum((values[a:b].astype(U64) + U64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * MIX_2)
        i = j
    return out


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library keeps its own counsel
        return lambda _: 0


def release() -> None:
    """Give freed memory back, so that a worker holds what it uses now and not the most it ever used."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets in them) of runs of rows of about `most` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that `parts` doesn't mark; no word spans two rows."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~parts[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] |= inside[firsts]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    ends[lasts] |= inside[lasts]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z lower-cased."""
    return segment_hashes(LOWER[data], starts, ends)


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its first word) of each run of n words within a row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    x = mix(hashes[at] + seed(n))
    for k in range(1, n):
        x = mix(x * MIX_1 + hashes[at + k])
    return x, at


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several runs, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct hashes of n-word shingles of each row) slice by slice; a row of fewer words has its
    whole sequence as one shingle, a row without words an empty set."""
    for first, last, data, offsets in slices(column):
        starts, ends, rows = words(data, offsets)
        hashed = word_hashes(data, starts, ends)
        grams, at = ngrams(hashed, rows, n)
        counts = np.bincount(rows, minlength=last - first)
        cuts = np.searchsorted(rows[at], np.arange(last - first + 1))
        begin = np.concatenate(([0], np.cumsum(counts)))
        sets = []
        for k in range(last - first):
            if cuts[k + 1] > cuts[k]:
                sets.append(np.unique(grams[cuts[k] : cuts[k + 1]]))
            elif counts[k]:
                x = U64(counts[k])
                one = np.full(1, seed(0) + x, U64)
                for h in hashed[begin[k] : begin[k + 1]]:
                    one = mix(one * MIX_1 + h)
                sets.append(one)
            else:
                sets.append(np.empty(0, U64))
        yield first, sets
