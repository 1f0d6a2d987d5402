"""Whitening of embeddings by matrix-free block subspace iteration (operator 12).

The covariance is never formed: each pass over the fit list computes X'(XQ) on centred rows for a block Q of columns, task by
task, and the sums meet in a table of dimensions x columns. The driver holds these narrow matrices alone: it orthogonalises
the block against the subspace so far (QR), solves the small projected problem (Rayleigh-Ritz) and goes on with the residuals
of the leading Ritz vectors, until a last pass over these vectors themselves certifies all k components. The subspace keeps
its earlier blocks, as spectra of embeddings are flat: where the next eigenvalues are a hundredth apart, a block alone
would need hundreds of passes, the kept blocks a handful. It is contracted to its leading vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import ARROW_BATCHES, Scratch

#: Entries are cut to whole multiples of 1/SCALE.
SCALE = 256
COMPONENTS = 4
#: Columns of a block, and of the subspace at most.
BLOCK, SUBSPACE = 16, 128
#: Residuals are certified below this share of the largest eigenvalue; passes at most.
TOLERANCE, PASSES = 1e-13, 200
#: Eigenvalues below this share of the largest are no components.
FLAT = 1e-12


def cut(vector: Column) -> Column:
    """A vector's entries as whole multiples of 1/SCALE, rounded down, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector has entries and each of them is a finite number."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


@dataclass(frozen=True)
class Model:
    """What whitening needs: rows and sums of the fit list, components in columns, their eigenvalues, the trace, and how far
    the whitened covariance is from the identity."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _rows(batch.column(0), width)
                # halves of 32 bits, so that no batch's sum leaves the range of a long
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array([*(x >> 32).sum(0).tolist(), 0]), pa.array([*(x & 0xFFFFFFFF).sum(0).tolist(), len(x)])], ["cell", "high", "low"])

    return run


def _products(mean: np.ndarray, block: np.ndarray):
    width, columns = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, gram, squares = np.zeros((width, columns)), np.zeros((columns, columns)), 0.0
        for batch in batches:
            x = _rows(batch.column(0), width) - mean
            y = x @ block
            product += x.T @ y
            gram += y.T @ y
            squares += float((x * x).sum())
        cells = np.concatenate((product.ravel(), gram.ravel(), [squares]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    return run


class Passes:
    """Passes over a fit list, a table of one column x of vectors of `width` longs."""

    def __init__(self, fit_list: DataFrame, width: int):
        self.list, self.width, self.done = fit_list, width, 0
        sums = fit_list.mapInArrow(_sums(width), "cell long, high long, low long").groupBy("cell").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
        got = {r.cell: (int(r.high) << 32) + int(r.low) for r in sums.collect()}
        self.n = got.pop(width, 0)
        self.sums = tuple(got.get(k, 0) for k in range(width))
        self.mean = np.array([s / max(self.n, 1) for s in self.sums])

    def covariance_times(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(V Q, Q' V Q, trace of V) for the covariance V and a block Q, in one pass. A task gives a row for each cell of
        these, whatever its rows; the driver gets their sums."""
        columns = block.shape[1]
        cells = self.list.mapInArrow(_products(self.mean, block), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        out = np.zeros(self.width * columns + columns * columns + 1)
        for r in cells.collect():
            out[r.cell] = r.value
        self.done += 1
        out /= self.n
        own = self.width * columns
        return out[:own].reshape(self.width, columns), out[own:-1].reshape(columns, columns), float(out[-1])


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what the block adds to a basis; columns that add nothing are left out."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        block, upper = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(upper)) > 1e-10]
    return block


def leading(passes: Passes, k: int, block: int = BLOCK, subspace: int = SUBSPACE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(components in columns, eigenvalues, Q' V Q of the certifying pass, trace): the k leading eigenpairs of the covariance,
    fewer if it has fewer that aren't 0."""
    width = passes.width
    k = min(k, width)
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    new = np.linalg.qr(np.random.default_rng(12).standard_normal((width, min(max(block, k), width))))[0]
    best = None
    while True:
        product, gram, trace = passes.covariance_times(new)
        basis, image = np.hstack((basis, new)), np.hstack((image, product))
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, far = basis @ turns[:, : max(block, k)], image @ turns[:, : max(block, k)]
        residuals = far - ritz * values[: ritz.shape[1]]
        sizes = np.linalg.norm(residuals[:, :k], axis=0)
        whole_space = basis.shape[1] >= width
        if sizes.max() <= tolerance * max(values[0], 0) or whole_space or passes.done >= PASSES:
            # a pass over the vectors themselves tells whether they are what the sums so far make of them
            found = np.linalg.qr(ritz[:, :k])[0]
            product, gram, trace = passes.covariance_times(found)
            values, turns = np.linalg.eigh((gram + gram.T) / 2)
            values, turns = values[::-1], turns[:, ::-1]
            found, product, gram = found @ turns, product @ turns, turns.T @ gram @ turns
            left = float(np.linalg.norm(product - found * values, axis=0).max())
            bound = tolerance * max(values[0], 0)
            # rounding of sums over the rows bounds what a pass can certify: near it, a residual that no longer falls is the end
            stuck = best is not None and left > best[0] / 2 and best[0] <= 1000 * bound
            if best is None or left < best[0]:
                best = (left, found, values, gram)
            if left <= 10 * bound or whole_space or stuck:
                break
            if passes.done >= PASSES:
                raise RuntimeError(f"residuals of {left / max(values[0], 1e-300):.1e} of the largest eigenvalue are left after {passes.done} passes")
            residuals, ritz = product - found * values, found
        if basis.shape[1] + residuals.shape[1] > max(subspace, 3 * max(block, k)):
            small = basis.T @ image
            turns = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, : 2 * max(block, k)]
            basis, image = basis @ turns, image @ turns
        new = _orthonormal(residuals, basis)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(passes.done).standard_normal((width, max(block, k))), basis)
    _, found, values, gram = best
    keep = values > FLAT * max(values[0], 0)
    return found[:, keep], values[keep], gram[np.ix_(keep, keep)], trace


def fit(vectors: DataFrame, k: int = COMPONENTS, block: int = BLOCK, subspace: int = SUBSPACE) -> Model | None:
    """Fits on each distinct x of `vectors` once (one column x, arrays of longs of one length); None without rows. The
    distinct vectors are written to the shared folder, so that a pass is a scan of them, and a lost executor costs a reread."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    fit_list = scratch.save(vectors.select("x").distinct())
    first = fit_list.head()
    if first is None:
        return None
    passes = Passes(fit_list, len(first.x))
    found, values, gram, trace = leading(passes, k, block, subspace)
    roots = np.sqrt(values)
    error = float(np.abs(gram / np.outer(roots, roots) - np.eye(len(roots))).max(initial=0.0))
    scratch.drop(fit_list)
    return Model(passes.n, passes.sums, found, values, trace, error, passes.done)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, k = model.n, np.array(model.sums, object), len(model.values)
        mean, scale = np.array([s / n for s in model.sums]), model.components / np.sqrt(model.values)
        largest = max(map(abs, model.sums), default=0)
        for batch in batches:
            if not len(batch) or not k:
                continue
            x = _rows(batch.column(1), len(sums))
            # as longs where no square can leave their range, else as Python's whole numbers
            if (n * int(np.abs(x).max()) + largest) ** 2 * len(sums) < 1 << 63:
                deviation = ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [d if (d := int(((n * row.astype(object) - sums) ** 2).sum())) < 1 << 63 else None for row in x]
            whitened = (x - mean) @ scale
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()), pa.array(whitened.ravel()), pa.array(np.tile(model.values / model.trace, rows)), pa.array(np.full(rows * k, model.identity_error)),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return run


def whiten(embeddings: DataFrame, k: int = COMPONENTS, block: int = BLOCK, subspace: int = SUBSPACE) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error for each
    vector and leading component, fitted on the distinct vectors.

    Rows whose vector is null, empty or holds null or non-finite entries are left out. Vectors must have one length; where
    they don't, those of another than the commonest (of equals the longest) are left out too. Repeated rows and null ids are
    rows as any others, extra columns are left out. Where fewer than k eigenvalues aren't 0 there are fewer components; an
    empty table, or one distinct vector, gives none and so no rows. deviation is null where it doesn't fit a long, and an
    entry beyond a long's range is the nearest long."""
    for key, value in ARROW_BATCHES.items():
        embeddings.sparkSession.conf.set(key, value)
    rows = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), cut(F.col("embedding")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head()
    if lengths is not None:
        rows = rows.where(F.size("x") == lengths.width)
        model = fit(rows, k, block, subspace)
        if len(model.values):
            return rows.mapInArrow(_whiten(model), SCHEMA)
    return embeddings.sparkSession.createDataFrame([], SCHEMA)
