"""Model fitting by pyspark.ml and by boosting over histograms, and the two kernels that need numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import BoostConfig


def clustered(rows: DataFrame, vector: str, k: int = 4, seed: int = 0, starts: int = 20) -> DataFrame:
    """cluster: 0 for the darkest centre, and up, of the fit of least cost among `starts` ones; the centres' order, not the
    fit's."""
    featured = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    fits = [KMeans(k=k, seed=seed + i, maxIter=20, featuresCol="features", predictionCol="raw").fit(featured) for i in range(starts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    order = np.argsort([c.mean() for c in model.clusterCenters()])
    ranks = F.array(*[F.lit(int(np.flatnonzero(order == i)[0])) for i in range(k)])
    return model.transform(featured).withColumn("cluster", F.element_at(ranks, F.col("raw") + 1)).drop("features", "raw")


def tile_spread(clustered: DataFrame, vector: str) -> DataFrame:
    """(tile, spread): each cell's standard deviation within the clusters, weighted by their sizes."""
    cells = clustered.select("cluster", F.posexplode(vector).alias("tile", "x")).groupBy("cluster", "tile").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    return cells.groupBy("tile").agg(F.sqrt(F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("spread"))


def projected(rows: DataFrame, vector: str, k: int = 8) -> DataFrame:
    """Principal components; their signs are arbitrary."""
    featured = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(featured).transform(featured).withColumn("components", vector_to_array("pc")).drop("features", "pc")


def boosted(train: DataFrame, features: list[str], label: str, c: BoostConfig = BoostConfig()):
    """A function that adds score: the probability that a row is positive, by trees fitted to all of `train`."""
    models = boosting.fit(train, features, label, c=c)
    return lambda rows: rows.withColumn("score", boosting.score(models, [F.col(f) for f in features]))


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: str, folds: int = 5, c: BoostConfig = BoostConfig()) -> DataFrame:
    """Each row scored by a model that has seen no row of its group's fold; the models grow side by side. A null group is a
    group."""
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    models = boosting.fit(dealt, features, label, "fold", folds, c)
    return dealt.withColumn("score", boosting.score(models, [F.col(f) for f in features], F.col("fold")))


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, confidence) of b against a by phase correlation under a Hann window, with a parabola through the peak."""
    h, w = a.shape
    window = np.outer(np.hanning(h), np.hanning(w))
    cross = np.fft.fft2((a - a.mean()) * window) * np.conj(np.fft.fft2((b - b.mean()) * window))
    surface = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-9)).real
    y, x = np.unravel_index(surface.argmax(), surface.shape)

    def vertex(l: float, m: float, r: float) -> float:
        bend = l - 2 * m + r
        return 0.0 if abs(bend) < 1e-12 else 0.5 * (l - r) / bend

    dy = y + vertex(surface[y - 1, x], surface[y, x], surface[(y + 1) % h, x])
    dx = x + vertex(surface[y, x - 1], surface[y, x], surface[y, (x + 1) % w])
    return float(dy - h if dy > h / 2 else dy), float(dx - w if dx > w / 2 else dx), float(surface.max() / (surface.std() + 1e-12))


def shifts(pairs: DataFrame, h: int, w: int) -> DataFrame:
    """(id, dy, dx, confidence) of pairs (id, a, b) of grids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *phase_shift(np.asarray(a, float).reshape(h, w), np.asarray(b, float).reshape(h, w))) for i, a, b in zip(batch["id"], batch["a"], batch["b"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "dy", "dx", "confidence"])

    return pairs.select("id", "a", "b").mapInPandas(run, "id long, dy double, dx double, confidence double")


def regime_bank(rows: DataFrame, key: str, order: list[str], descriptor: str, near: float = 0.18, most: int = 5) -> DataFrame:
    """(id, regime, distance, regimes): descriptors join the nearest regime of their key's bank, or found one if none is
    near; beyond `most` the two closest merge, weighted by their counts. A key's rows are a bounded span, as in batch folds."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bank: list[list] = []
        out, named = [], 0
        for event, d in frame.sort_values(order)[["id", descriptor]].itertuples(index=False):
            d = np.asarray(d, float)
            gaps = [float(np.linalg.norm(m[0] - d)) for m in bank]
            k = int(np.argmin(gaps)) if gaps else -1
            if k < 0 or gaps[k] > near:
                bank.append([d, 1, named])
                out.append((event, named, gaps[k] if gaps else float("inf"), len(bank)))
                named += 1
                if len(bank) > most:
                    pairs = [(float(np.linalg.norm(bank[i][0] - bank[j][0])), i, j) for i in range(len(bank)) for j in range(i + 1, len(bank))]
                    _, i, j = min(pairs)
                    a, b = bank[i], bank.pop(j)
                    a[0], a[1] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]
            else:
                m = bank[k]
                m[0], m[1] = m[0] + (d - m[0]) / (m[1] + 1), m[1] + 1
                out.append((event, m[2], gaps[k], len(bank)))
        return pd.DataFrame(out, columns=["id", "regime", "distance", "regimes"])

    return rows.groupBy(key).applyInPandas(run, "id long, regime int, distance double, regimes int")


def scene_breaks(rows: DataFrame, key: str, order: list[str], value: str, limit: float = 30.0, fast: int = 7) -> DataFrame:
    """(id, residual, break): a mean that follows at rate 0.15; a residual over `limit` resets it, and then it follows at
    rate 0.5 for `fast` frames."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mean, left, out = None, 0, []
        for event, x in frame.sort_values(order)[["id", value]].itertuples(index=False):
            residual = 0.0 if mean is None else abs(float(x) - mean)
            broke = mean is None or residual > limit
            if broke:
                mean, left = float(x), fast
            else:
                rate, left = (0.5, left - 1) if left else (0.15, 0)
                mean += rate * (float(x) - mean)
            out.append((event, residual, broke))
        return pd.DataFrame(out, columns=["id", "residual", "broke"])

    return rows.groupBy(key).applyInPandas(run, "id long, residual double, broke boolean")
