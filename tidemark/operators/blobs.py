"""Connected components of masks of image size, by runs instead of cells.

A mask's rows are cut into runs of set cells; runs that touch in neighbouring rows are joined, all at once: each run takes the
smallest root among itself and what it touches, roots follow their own roots, until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column + 1) of each run of set cells, row by row."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    return row, start, np.nonzero(edges == -1)[1]


def components(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, component) of the runs: a component is its first run's number; `diagonal`: corners touch too."""
    row, start, end = runs_of(mask)
    n, width, reach = len(row), mask.shape[1] + 3, int(diagonal)
    # of each run, those of the next row that end behind its start and start before its end
    low = np.searchsorted(row * width + end, (row + 1) * width + start - reach, "right")
    high = np.searchsorted(row * width + start, (row + 1) * width + end + reach, "left")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), many)
    b = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(a))
    root = np.arange(n)
    while len(a):
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            break
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return row, start, end, root


def sizes(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Cells of each component, in the order of their first cells."""
    _, start, end, root = components(mask, diagonal)
    return np.bincount(root, weights=end - start)[np.unique(root)].astype(np.int64) if len(root) else np.empty(0, np.int64)


def blob_sizes(masks: DataFrame, key: str, mask: str, width: str, diagonal: bool = True) -> DataFrame:
    """(key, cells, sizes): of each row's mask, an array of booleans in rows of `width` cells, the set cells and the sizes of
    their components, largest first. A last row that is short is filled up; null and empty masks have none, null cells
    are not set. A mask is one row's, so it is met by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, found = [], []
            for k in range(len(batch)):
                flat = np.array(batch.column(1)[k].values.fill_null(False).to_numpy(zero_copy_only=False), bool) if batch.column(1)[k].is_valid else np.empty(0, bool)
                w = batch.column(2)[k].as_py() or 1
                own = sizes(np.pad(flat, (0, -len(flat) % w)).reshape(-1, w), diagonal)
                cells.append(int(flat.sum()))
                found.append(np.sort(own)[::-1])
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *found])))], [key, "cells", "sizes"])

    kind = masks.schema[key].dataType.simpleString()
    return masks.select(key, F.col(mask).cast("array<boolean>"), F.col(width).cast("int")).mapInArrow(run, f"`{key}` {kind}, cells long, sizes array<bigint>")
