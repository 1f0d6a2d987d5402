"""Gradient boosting over histograms: trees of log loss whose splits come from sums of binned rows.

Features are cut into bins once and rows that agree in all bins become one cell, counted by fold and label, so what a pass
reads stops growing with the table. A block of up to PART cells is one row of arrays, a feature or a model after another. Each
level of a tree is one pass: tasks place their cells in the tree so far and sum gradients and curvatures for each node, feature
and bin, and the driver reads those sums, whose number is fixed by the parameters, to choose splits. The models of all folds
grow in the same passes, each from the rows outside its fold. Cells' scores are written every CUT trees, so a pass repeats at
most that many and a lost executor costs a reread. Sums are taken over integers, so trees don't hang on the order of rows,
partitions or retries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.operators.evaluation import running_sums
from tidemark.sources.storage import scratch_path

#: Steps of a gradient: its sums stay exact over 2**37 rows. Trees between two writings, cells to a block, and blocks whose sums
#: the driver adds up itself, as that is less work than a shuffle; those of more are added up in tasks.
STEPS, CUT, PART, FEW = 1 << 26, 25, 25_000, 16


@dataclass(frozen=True)
class BoostConfig:
    """The published depth, rounds and rate, and the usual least leaf, curvature and number of bins."""

    depth: int = 3
    rounds: int = 250
    rate: float = 0.06
    least_rows: int = 20
    least_curvature: float = 1e-3
    bins: int = 255


@dataclass
class Tree:
    """A tree of fixed depth; node n has the children 2 n + 1 and 2 n + 2. feature is -1 at a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Each row's node. Codes are bins from 1, 0 where the feature is missing; unsigned, a row of them for each feature."""
        depth = int(math.log2(len(self.feature) + 1)) - 1
        ends = np.arange(len(self.feature))  # the node that a row ends at below one, without splits
        for at in np.flatnonzero(self.feature < 0).tolist():
            for child in (2 * at + 1, 2 * at + 2):
                if child < len(ends):
                    ends[child] = ends[at]
        # places of a level are counted from 0, below an unsplit node as though all its rows went left
        place = np.zeros(codes.shape[1], np.uint8 if depth < 8 else np.uint32)
        for level in range(depth):
            first, right = 2**level - 1, np.zeros(codes.shape[1], bool)
            for at in range(2**level):
                node = first + at
                if self.feature[node] >= 0:
                    code, cut = codes[self.feature[node]], int(self.bin[node])
                    own = code > cut if self.missing_left[node] else code - code.dtype.type(1) >= cut  # 0 - 1 is the largest
                    right |= own & (place == at) if level else own
            place = 2 * place + right
        return ends[2**depth - 1 :][place]


@dataclass
class Model:
    """Boosted trees: the score of codes is base + the sum of the trees' values, through the logistic function."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of values: bin k takes values over edge k - 1 up to edge k, counted from 1; 0 for missing ones."""
        kind = _kind(max(map(len, self.edges), default=0) + 1)
        return np.stack([np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left") + 1).astype(kind) for e, v in zip(self.edges, columns, strict=True)])

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        codes = self.codes(columns)
        return 1 / (1 + np.exp(-(self.base + sum((t.value[t.place(codes)] for t in self.trees), np.zeros(codes.shape[1])))))


def _kind(most: int) -> type:
    """Unsigned codes up to `most`."""
    return np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """For each feature at most bins - 1 edges: the middles between neighbouring values where there are at most `bins`, else
    the values at whose ranks the rows fall into `bins` equal parts, by running sums over counted values. Null and NaN are
    missing and have no part in it. Infinite values raise an error."""
    out, path = [], scratch_path(rows.sparkSession, "edges")
    for at, name in enumerate(features):
        own = rows.select(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
        own.write.parquet(f"{path}/{at}")
        own = rows.sparkSession.read.schema(own.schema).parquet(f"{path}/{at}")
        values = np.sort(own.select("v").limit(bins + 1).toPandas()["v"].to_numpy(float))
        if len(values) > bins:
            part = lambda rank: F.floor(rank * bins / F.col("all_n"))
            ends = running_sums(own, "v", ["n"]).where(part(F.col("before_n")) < part(F.col("before_n") + F.col("n"))).where(F.col("before_n") + F.col("n") < F.col("all_n"))
            out.append(np.sort(ends.select("v").toPandas()["v"].to_numpy(float)))
        else:
            out.append(values[:-1] / 2 + values[1:] / 2)
        if np.isinf(values).any() or np.isinf(out[-1]).any():
            raise ValueError(f"{name} holds infinite values")
    return out


def fit(rows: DataFrame, features: list[str], label: str, fold: str | None = None, folds: int = 1, c: BoostConfig = BoostConfig()) -> list[Model]:
    """A model for each fold, from the rows of the other folds (all rows and one model if `fold` is None). Labels over 0.5
    are positive; rows without a label or fold teach nothing. Without rows, or with one label alone, a model has no trees and
    its base stands for the share of positives, moved a thousandth from 0 and 1."""
    spark, width = rows.sparkSession, len(features)
    number = F.lit(-1) if fold is None else F.col(fold).cast("int")
    taught = rows.where(F.col(label).isNotNull() & number.isNotNull())
    taught = taught.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], number.alias("fold"), (F.col(label).cast("double") > 0.5).cast("long").alias("y"))
    path = scratch_path(spark, "boosting")
    taught.write.parquet(f"{path}/taught")  # read once for each feature and once for the cells
    taught = spark.read.schema(taught.schema).parquet(f"{path}/taught")
    edges = bin_edges(taught, [f"f{i}" for i in range(width)], c.bins)
    codes = [f"c{i}" for i in range(width)]
    of = lambda f, what: F.sum(F.when(F.col("fold") == f, what).otherwise(0))
    counts = [F.count("*").alias("n"), F.sum("y").alias("k"), *[of(f, F.lit(1)).alias(f"n{f}") for f in range(folds)], *[of(f, F.col("y")).alias(f"k{f}") for f in range(folds)]]
    coded = taught.mapInArrow(_coded(edges, width), ", ".join([*[f"{x} int" for x in codes], "fold int", "y long"]))
    cells = coded.groupBy(*codes).agg(*counts)
    cells.write.parquet(f"{path}/counted")
    cells = spark.read.schema(cells.schema).parquet(f"{path}/counted")
    total = cells.agg(F.count("*").alias("cells"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in cells.columns[width:]]).first()
    models, able = [], []
    for f in range(folds):
        n, k = total.n - total[f"n{f}"], total.k - total[f"k{f}"]
        share = min(max(k / n if n else 0.0, 1e-3 if k in (0, n) else 0.0), 1 - 1e-3 if k in (0, n) else 1.0)
        models.append(Model(edges, math.log(share / (1 - share))))
        if 0 < k < n:
            able.append(f)
    if able and c.rounds:
        _grow(spark, cells, total.cells, models, able, width, path, c)
    return models


def _coded(edges: list[np.ndarray], width: int):
    """(features, fold, y) -> (codes, fold, y)."""
    model = Model(edges, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in model.codes(values)], *batch.columns[width:]], [*[f"c{i}" for i in range(width)], "fold", "y"])

    return run


BLOCK_SCHEMA = "cells int, codes binary, n binary, k binary, raw binary"


def _blocks(start: list[float], able: list[int], width: int, kind: type, size: int):
    """Counted cells -> blocks: codes by feature; by model the rows outside its fold, the positives among them, and scores."""

    def block(table: pa.Table) -> pa.RecordBatch:
        columns = {x: table[x].to_numpy() for x in table.column_names}
        codes = np.stack([columns[f"c{i}"] for i in range(width)]).astype(kind)
        n, k = (np.stack([columns[x] - columns[f"{x}{f}"] for f in able]) for x in "nk")
        raw = np.repeat(np.array(start)[:, None], table.num_rows, axis=1)
        return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (codes, n, k, raw)]], ["cells", "codes", "n", "k", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield block(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return run


def _grow(spark, cells: DataFrame, n_cells: int, models: list[Model], able: list[int], width: int, path: str, c: BoostConfig) -> None:
    """Give each model in `able` its trees, a level of a tree of all of them in a pass."""
    parts, kind = -(-n_cells // PART), _kind(c.bins)
    dealt = cells.coalesce(1) if parts == 1 else cells.repartition(parts)
    held = _written(spark, dealt.mapInArrow(_blocks([models[f].base for f in able], able, width, kind, PART), BLOCK_SCHEMA), f"{path}/0", parts)
    recent: list[list[Tree]] = [[] for _ in able]
    for turn in range(c.rounds):
        if turn and turn % CUT == 0:
            older = held
            held = _written(spark, held.mapInArrow(_advance(recent, width, kind), BLOCK_SCHEMA), f"{path}/{turn}", parts)
            older.unpersist()
            recent = [[] for _ in able]
        trees = [Tree.empty(c.depth) for _ in able]
        for level in range(c.depth):
            sums = held.mapInArrow(_summed(recent, trees, level, width, kind, c.bins + 1), "slot int, g long, h long, n long")
            if parts > FEW:
                sums = sums.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
            sums = sums.toArrow()
            table = np.zeros((3, len(able) * 2**level * width * (c.bins + 1)), np.int64)
            for i, name in enumerate(("g", "h", "n")):
                np.add.at(table[i], sums["slot"].to_numpy(), sums[name].to_numpy())
            _split(table.reshape(3, len(able), 2**level, width, c.bins + 1), trees, level, c)
        for f, tree, own in zip(able, trees, recent, strict=True):
            models[f].trees.append(tree)
            own.append(tree)
    held.unpersist()


def _written(spark, df: DataFrame, path: str, parts: int) -> DataFrame:
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return (out.coalesce(1) if parts == 1 else out).persist()


def _read(batch: pa.RecordBatch, at: int, width: int, kind: type) -> tuple[np.ndarray, ...]:
    """(codes by feature, rows, positives and scores by model) of a block."""
    return tuple(np.frombuffer(batch[name][at].as_buffer(), t).reshape(-1, batch["cells"][at].as_py()) for name, t in (("codes", kind), ("n", np.int64), ("k", np.int64), ("raw", np.float64)))


def _advance(recent: list[list[Tree]], width: int, kind: type):
    """Add the trees since the last writing to the cells' scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for at in range(batch.num_rows):
                codes, _, _, before = _read(batch, at, width, kind)
                raw.append(np.stack([_scored(codes, x, trees) for x, trees in zip(before, recent, strict=True)]).tobytes())
            yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(raw, pa.binary()))

    return run


def _scored(codes: np.ndarray, raw: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """A model's scores of a block's cells."""
    for t in trees:
        raw = raw + t.value[t.place(codes)]
    return raw


def _summed(recent: list[list[Tree]], trees: list[Tree], level: int, width: int, kind: type, bins: int):
    """Sums of gradients, curvatures and rows for each model, node of the level, feature and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, nodes = 2**level - 1, 2**level
        sums = np.zeros((3, len(trees), nodes, width, bins), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                codes, n, k, raw = _read(batch, at, width, kind)
                for m, tree in enumerate(trees):
                    node = tree.place(codes) - first
                    live = np.flatnonzero((node >= 0) & (n[m] > 0))
                    node, rows, hits = node[live], n[m, live], k[m, live]
                    p = 1 / (1 + np.exp(-_scored(codes, raw[m], recent[m])[live]))
                    up, down, bend = (np.rint(x * STEPS).astype(np.int64) for x in (p, 1 - p, p * (1 - p)))
                    values = (up * (rows - hits) - down * hits, bend * rows, rows)
                    for f in range(width):
                        slot = node * bins + codes[f, live]
                        for i, v in enumerate(values):
                            own = np.zeros(nodes * bins, np.int64)
                            np.add.at(own, slot, v)
                            sums[i, m, :, f] += own.reshape(nodes, bins)
        sums = sums.reshape(3, -1)
        slot = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), *[pa.array(x[slot]) for x in sums]], names=["slot", "g", "h", "n"])

    return run


def _split(sums: np.ndarray, trees: list[Tree], level: int, c: BoostConfig) -> None:
    """Split the nodes of a level where the loss falls most; of equal falls the first feature, missing values to the left,
    and the lowest bin win. Values of leaves and of their children are set on the way."""
    for m, tree in enumerate(trees):
        for at in range(2**level):
            node = 2**level - 1 + at
            if level and tree.feature[(node - 1) // 2] < 0:
                continue
            best, found = 0.0, None
            own = sums[:, m, at]
            whole = own[:, 0].sum(axis=1)
            for f in range(own.shape[1]):
                missing, upto = own[:, f, 0], own[:, f, 1:].cumsum(axis=1)
                for left_missing in (True, False):
                    g, h, n = upto + (missing[:, None] if left_missing else 0)
                    og, oh, on = whole[:, None] - np.stack([g, h, n])
                    fits = (n >= c.least_rows) & (on >= c.least_rows) & (h >= c.least_curvature * STEPS) & (oh >= c.least_curvature * STEPS)
                    fall = np.where(fits, g / np.maximum(h, 1) * g + og / np.maximum(oh, 1) * og - whole[0] / max(whole[1], 1) * whole[0], -1.0)
                    k = int(fall.argmax())
                    if fall[k] > best:
                        best, found = fall[k], (f, k + 1, left_missing, (g[k], h[k]), (og[k], oh[k]))
            if level == 0:
                tree.value[node] = -c.rate * whole[0] / max(whole[1], 1)
            if found:
                tree.feature[node], tree.bin[node], tree.missing_left[node] = found[:3]
                for child, (g, h) in zip((2 * node + 1, 2 * node + 2), found[3:], strict=True):
                    tree.value[child] = -c.rate * g / max(h, 1)


def score(models: list[Model], features: list[Column], fold: Column | None = None) -> Column:
    """The probability that a row is positive, by the model of its fold (the first one without folds). Trees and edges travel
    in the function: their size is fixed by rounds, depth, bins and folds. Rows without a fold have no score."""

    @pandas_udf("double")
    def run(number: pd.Series, *columns: pd.Series) -> pd.Series:
        out = np.full(len(number), np.nan)
        values = [v.to_numpy(float) for v in columns]
        for f, model in enumerate(models):
            own = (number == f).to_numpy()
            if own.any():
                out[own] = model.score([v[own] for v in values])
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run(F.lit(0) if fold is None else fold, *[f.cast("double") for f in features])
