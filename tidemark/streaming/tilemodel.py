"""The background of a device's tiles as a stream's state, a model for each bucket of brightness: a frame is judged by its
bucket's model, and what the judgement says decides whether it then teaches it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import blobs

OUT = "device long, id long, bucket int, warmup int, ratio double, dark_tiles int, dark_blob int, texture_blob int, trigger string, label string, taught boolean"


@dataclass(frozen=True)
class TileConfig:
    """The published limits, rates and floors. edges: least mean levels of the brighter buckets; need: frames that
    a bucket learns from before it judges; rough, loose: a textured tile's least roughness and darkness."""

    edges: tuple[float, ...] = ()
    need: int = 1
    z: float = 3.0
    quiet: float = 0.25
    dark: float = 20.0
    blob: int = 5
    chroma_sq: float = 64.0
    rough: float = 12.0
    loose: float = 10.0
    floor: float = 20.0
    least: int = 10
    trim: float = 0.1
    alpha: float = 0.15
    variance_floor: float = 36.0
    start_mean: float = 128.0
    start_variance: float = 256.0


class Tiles:
    """One bucket's model: the levels of its three planes, the luma's variance and how many frames taught it."""

    def __init__(self, levels: np.ndarray, variance: np.ndarray, taught: int):
        self.levels, self.variance, self.taught = levels, variance, taught

    @classmethod
    def new(cls, shape: tuple[int, int], c: TileConfig) -> Tiles:
        return cls(np.full((3, *shape), c.start_mean), np.full(shape, c.start_variance), 0)

    def expected(self, luma: np.ndarray, c: TileConfig) -> np.ndarray:
        """The model's luma in the frame's light: a line through tiles that aren't black, fitted again without the worst."""
        lit = self.levels[0] > c.floor
        x, y = self.levels[0][lit], luma[lit]
        if len(x) < c.least or x.std() <= 1.0:
            return self.levels[0]
        off = np.abs(np.polyval(np.polyfit(x, y, 1), x) - y)
        kept = np.argsort(off, kind="stable")[: max(c.least, int(len(x) * (1 - c.trim)))]
        return np.polyval(np.polyfit(x[kept], y[kept], 1), self.levels[0])

    def judged(self, planes: np.ndarray, rough: np.ndarray, c: TileConfig) -> tuple:
        """(warmup, ratio, dark_tiles, dark_blob, texture_blob, trigger, label). A colour shift counts beside the frame's own
        median shift, and only in tiles that are darker than expected; blobs touch by corners."""
        gap = planes[0] - self.expected(planes[0], c)
        darker = gap < 0
        ratio = float(((np.abs(gap) / np.sqrt(self.variance) > c.z) & darker).mean())
        shift = planes[1:] - self.levels[1:]
        shift = shift - np.median(shift, axis=(1, 2), keepdims=True)
        dark = (gap < -c.dark) | (((shift**2).sum(axis=0) > c.chroma_sq) & darker)
        largest = [int(blobs.sizes(m, True).max(initial=0)) for m in (dark, (rough > c.rough) & (gap < -c.loose))]
        warmup = max(0, c.need - self.taught)
        compact = any(1 <= n <= c.blob for n in largest)
        trigger = "WARMUP" if warmup else "DARK_BLOB" if compact else "QUIET" if ratio <= c.quiet else "AMBIGUOUS"
        return warmup, ratio, int(dark.sum()), *largest, trigger, "clouds" if trigger == "QUIET" else "process"

    def after(self, planes: np.ndarray, c: TileConfig) -> Tiles:
        """The model that the frame leaves: the variance takes the residual after the mean has moved."""
        levels = (1 - c.alpha) * self.levels + c.alpha * planes
        variance = np.maximum((1 - c.alpha) * self.variance + c.alpha * (planes[0] - levels[0]) ** 2, c.variance_floor)
        return Tiles(levels, variance, min(self.taught + 1, 65535))


class _Devices(StatefulProcessor):
    def __init__(self, height: int, width: int, config: TileConfig):
        self.shape, self.config = (height, width), config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("buckets", "bucket int", "grids binary, taught int")

    def _bucket(self, k: int) -> Tiles:
        if not self.buckets.containsKey((k,)):
            return Tiles.new(self.shape, self.config)
        grids, taught = self.buckets.getValue((k,))
        layers = np.frombuffer(grids).reshape(4, *self.shape)
        return Tiles(layers[:3], layers[3], taught)

    def handleInputRows(self, key: tuple, batches: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        held: dict[int, Tiles] = {}
        learned, out = set(), []
        for event, timer, *grids in zip(rows["id"], rows["timer"], rows["y"], rows["u"], rows["v"], rows["rough"], strict=True):
            *planes, rough = (np.asarray(g, float).reshape(self.shape) for g in grids)
            planes = np.array(planes)
            k = int(np.searchsorted(self.config.edges, int(planes[0].mean()), "right"))
            if k not in held:
                held[k] = self._bucket(k)
            found = held[k].judged(planes, rough, self.config)
            teaches = bool(timer) and found[-2] in ("WARMUP", "QUIET")
            if teaches:
                held[k] = held[k].after(planes, self.config)
                learned.add(k)
            out.append((key[0], event, k, *found, teaches))
        for k in learned:
            self.buckets.updateValue((k,), (np.concatenate((held[k].levels, held[k].variance[None])).tobytes(), held[k].taught))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def judged(stream: DataFrame, height: int, width: int, config: TileConfig = TileConfig()) -> DataFrame:
    """Each frame of a stream of (device, us, id, timer, y, u, v, rough), the last four its grids, with its bucket, what the
    bucket's model says of it and whether it taught the model: timer frames do while their bucket warms up and when they are
    quiet. Frames with a null grid have no result. Rows of a device within a batch are put in order, a batch behind another is
    later. A device's state is four grids for each of its buckets, of which those that learned are written."""
    rows = stream.select("device", "us", "id", "timer", "y", "u", "v", "rough").dropna(subset=["y", "u", "v", "rough"])
    return rows.groupBy("device").transformWithStateInPandas(_Devices(height, width, config), OUT, "append", "none")
