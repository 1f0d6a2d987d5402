"""Periodic runs of words by a harmonic grid (operator 11).

A run is a stretch of words that repeats with a period and can't be extended. One that holds `exponent` periods of length p
has as many neighbouring multiples of p in it. So for each p, the grid's neighbours jp and (j+1)p that lie within one are
extended forward and backward as far as the words behind and before them agree, and each run is found. How far they agree is
the longest common extension of two places: the least entry between their ranks among the lengths that neighbours in the
suffix array share. Backward extensions are those of the reversed words. Over all p the grid has n ln n places.

Texts are met in slices of about 1 MB. A slice's suffixes are sorted by row first, so equal texts cost nothing to tell apart,
and by doubling, where only suffixes that aren't unique yet are sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.storage import texts

#: A run has at least so many words, and so many times its period.
LEAST, EXPONENT = 6, 4
#: Places of the grid that are tested at once.
GRID = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Extensions:
    """Longest common extensions within rows of words: `words` (numbers) of rows that end at `ends`."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = len(words) + len(ends)
        self.shift = np.searchsorted(ends, np.arange(len(words)), "right")  # an end mark follows each row's words
        first = np.zeros(n, np.int64)
        first[np.arange(len(words)) + self.shift] = words + 1
        marks = ends + np.arange(len(ends))
        row = np.searchsorted(marks, np.arange(n))
        _, head = np.unique(row * (int(words.max(initial=0)) + 2) + first, return_inverse=True)
        order = np.argsort(head)
        self.rank = self._heads(head[order], order, n)
        self.levels: list[np.ndarray] = []
        slots, step = np.arange(n), 1
        while True:
            same = self.rank[order[slots]]
            size = np.bincount(same, minlength=n)
            open_ = slots[size[same] > 1]
            if not len(open_):
                break
            self.levels.append(self.rank.astype(np.int32))
            at = order[open_]
            key = self.rank[at] * (n + 1) + self.rank[at + step]
            by = np.argsort(key)
            order[open_] = at[by]
            key = key[by]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            self.rank[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            slots, step = open_, step * 2
        self.shared = self._shared(order, n)

    @staticmethod
    def _heads(sorted_: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        """The rank of each suffix: the first place of its like in `order`."""
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        return rank

    def _shared(self, order: np.ndarray, n: int) -> np.ndarray:
        """Words that each suffix of the array shares with the one before it, from the ranks by 2**k words."""
        out = np.zeros(n, np.int32)
        if not self.levels:
            return out
        at = np.flatnonzero(self.levels[0][order[1:]] == self.levels[0][order[:-1]]) + 1
        one, two, found = order[at].copy(), order[at - 1].copy(), np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            # the end of a row is unlike any other suffix, so no comparison goes beyond one
            step = np.where(self.levels[k][np.minimum(one + found, n - 1)] == self.levels[k][np.minimum(two + found, n - 1)], 1 << k, 0)
            found += step
        out[at] = found
        self.levels = []
        return out

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For places left < right of words of one row: how many words from there on agree."""
        a, b = self.rank[left + self.shift[left]], self.rank[right + self.shift[right]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(left), np.int64)
        least, k = self.shared, 0
        while True:  # range minima level by level, so that one level is held at a time
            mine = np.flatnonzero(level == k)
            out[mine] = np.minimum(least[low[mine]], least[high[mine] - (1 << k)])
            if not (level > k).any():
                return out
            least = np.minimum(least[: -(1 << k)], least[1 << k :])
            k += 1


def grid(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, period) of grid places where `exponent` neighbouring multiples of the period hold the same word."""
    periods = np.maximum(sizes - 1, 0) // (exponent - 1)
    rows = np.repeat(np.arange(len(sizes)), periods)
    period = K.runs(np.ones(len(sizes), np.int64), periods)
    counts = (sizes[rows] - 1) // period - (exponent - 2)
    total = np.cumsum(counts)
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + GRID, "right")))
        # one row and period may have more places than are tested at once
        before, most = 0, int(counts[i]) if j == i + 1 else 0
        while True:
            some = np.minimum(counts[i:j] - before, GRID) if most else counts[i:j]
            row, p = np.repeat(rows[i:j], some), np.repeat(period[i:j], some)
            at = begins[row] + p * (before + K.runs(np.zeros(j - i, np.int64), some))
            for k in range(1, exponent):
                same = words[at] == words[at + k * p]
                row, p, at = row[same], p[same], at[same]
            if len(at):
                yield row, at, p
            before += GRID
            if before >= most:
                break
        i = j


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period), by row, start and period, of the runs in rows of words (numbers)."""
    ends = np.cumsum(sizes)
    begins, n = ends - sizes, len(words)
    none = np.empty(0, np.int64)
    found = list(grid(words, begins, sizes, exponent)) if n else []
    if not found:
        return none, none, none, none
    row, at, p = (np.concatenate(x) for x in zip(*found, strict=True))
    live, of_live = np.unique(row, return_inverse=True)  # rows without a place of the grid have no run
    words, whole, sizes = words[K.runs(begins[live], sizes[live])], begins[live], sizes[live]
    ends = np.cumsum(sizes)
    begins, n = ends - sizes, len(words)
    at += begins[of_live] - whole[of_live]
    row = of_live
    ahead = Extensions(words, ends)(at, at + p)
    back = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > begins[row])
    if len(inner):
        # the word before a place is the word after it, read backwards
        mirror = Extensions(words[::-1], np.cumsum(sizes[::-1]))
        back[inner] = mirror(n - at[inner] - p[inner], n - at[inner])
    start, length = at - back, back + p + ahead
    fit = np.flatnonzero(length >= np.maximum(least, exponent * p))
    row, start, length, p = row[fit], start[fit], length[fit], p[fit]
    order = np.lexsort((p, length, start))  # starts are the slice's, so rows come in order
    row, start, length, p = row[order], start[order], length[order], p[order]
    # a multiple of a period finds the same stretch: the smallest is the run's
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(row) else np.empty(0, bool)
    row, start, length, p = row[new], start[new] - begins[row[new]], length[new], p[new]
    order = np.lexsort((p, start, row))
    return live[row[order]], start[order], length[order], p[order]


def _find(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in K.slices(batch.column(1)):
                starts, ends, rows = K.words(data, offsets)
                sizes = np.bincount(rows, minlength=last - first)
                _, words = np.unique(K.segment_hashes(data, starts, ends), return_inverse=True)
                row, at, length, period = find_runs(words.astype(np.int64), sizes, least, exponent)
                begins = np.cumsum(sizes) - sizes
                change = np.zeros(len(words) + 1, np.int64)  # words that runs repeat are marked by where marks begin and end
                np.add.at(change, begins[row] + at + period, 1)
                np.add.at(change, begins[row] + at + length, -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(sizes.astype(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)),
                            pa.StructArray.from_arrays([pa.array(at), pa.array(length), pa.array(period)], ["start", "length", "period"]),
                        ),
                        joined(data, starts[kept], ends[kept], np.bincount(rows[kept], minlength=last - first)),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The words of each row, joined by a space."""
    sizes = ends - starts + 1
    places = np.cumsum(sizes)
    out = np.empty(int(places[-1]) if len(places) else 0, np.uint8)
    gaps = places - 1
    inside = np.ones(len(out), bool)
    inside[gaps] = False
    out[inside] = data[K.runs(starts, sizes - 1)]
    out[gaps] = 0x20
    lasts = np.cumsum(counts)
    bounds = np.concatenate(([0], places))[np.concatenate(([0], lasts))]
    # no space follows a row's last word
    keep = np.ones(len(out), bool)
    keep[bounds[1:][counts > 0] - 1] = False
    offsets = np.concatenate(([0], np.cumsum(np.diff(bounds) - (counts > 0)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(out[keep]))


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start and length in words and smallest period of each, by start and period) and collapsed (the
    text with each run cut to its first period and words joined by one space) of each row's whole text.

    Words part at the six ASCII blanks and are equal if their bytes are. A run has `least` words and `exponent` (2 or more)
    times its period at least; an exponent below 4 or so tests more of the grid's places. Null and empty texts and those
    without words have no runs and an empty text. Null and repeated ids are rows as any others, extra columns are left out,
    an empty table gives an empty result. Time is n log n in a text's words; a worker holds some 200 bytes for each word of
    the longest text, more where repeats are long. No shuffle."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    return texts(docs).mapInArrow(_find(least, exponent), SCHEMA)


BLANKS = r"[\x20\x09-\x0D]+"


def tailed(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the rows whose hash of doc_id ends in 0 repeat a stretch of words up to their end: with
    h = crc32(doc_id), g = h div 10, a = g mod n and p = 1 + (n-a) div (3 + g mod 8), each word i >= a of n becomes word
    a + (i-a) mod p. Rows without a doc_id or words stay as they are."""
    own = texts(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string"))).withColumn("g", F.expr("h div 10"))
    own = own.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", BLANKS, -1), lambda w: w != ""))).withColumn("n", F.size("words"))
    own = own.withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS INT) END")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    tail = F.expr("transform(words, (w, i) -> CASE WHEN i < a THEN w ELSE get(words, a + (i - a) % p) END)")
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli (of equals the first, of these the one of
    least period; none: null), runs_sha256 and collapsed_sha256."""
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
