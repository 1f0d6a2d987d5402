"""The older background cascade, with stages that can be left out.

A key's frames are one sequence; every bucket of hours has a background of its own and remembers its previous frame. What
the cascade decides feeds back into the background, so a sequence is a fold in time, and keys must be bounded spans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("NIGHT", "WARMUP", "DARK_OBJ", "INDIRECT_LIGHT", "SPOT_CHANGE", "QUIET", "SCENE_DRIFT")
#: After these, and after any suppressed frame, the background learns the frame.
LEARNED = ("WARMUP", "SCENE_DRIFT", "NIGHT", "INDIRECT_LIGHT")


@dataclass(frozen=True)
class LegacyConfig:
    """Brightness in steps of 0 to 255. buckets: of hours. A limit of 0 switches its stage off. Two variants of what QUIET
    measures: dark_only, the share of cells that are odd and darker than the background; steady, over those cells alone whose
    deviation ('abs') or deviation by mean ('rel') is at most steady_limit. The values are the published defaults."""

    buckets: int = 4
    alpha: float = 0.15
    start_mean: float = 128.0
    start_variance: float = 256.0
    variance_floor: float = 36.0
    need: int = 3
    z: float = 3.0
    night: float = 70.0
    dark: float = 20.0
    dark_tiles: int = 1
    fresh_dark: float = 12.0
    drift_tiles: int = 6
    indirect: float = 0.0
    spot_tiles: int = 0
    spot_still: float = 3.0
    spot_dark: float = 15.0
    spot_noise: float = 10.0
    spot_noisy_tiles: int = 40
    quiet: float = 0.25
    dark_only: bool = False
    steady: str = ""
    steady_limit: float = 0.0


class _Background:
    """Mean, variance and age of one bucket, and the frame before."""

    def __init__(self, cells: int, c: LegacyConfig):
        self.c = c
        self.mean, self.variance = np.full(cells, c.start_mean), np.full(cells, c.start_variance)
        self.seen, self.previous = 0, None

    def stage(self, tile: np.ndarray, without: str) -> str:
        c, level = self.c, tile.mean()
        odd = np.abs(tile - self.mean) / np.sqrt(self.variance) > c.z
        dark = int((odd & (tile - self.mean < -c.dark)).sum())
        known = self.previous is not None
        since = tile - self.previous if known else np.zeros_like(tile)
        fresh = int((odd & (since < -c.fresh_dark)).sum()) if known else dark
        deviation = np.sqrt(self.variance)
        strange = odd & (tile < self.mean) if c.dark_only else odd
        if c.steady:
            spread = np.where(self.mean > 1, deviation / np.where(self.mean > 1, self.mean, 1.0), deviation) if c.steady == "rel" else deviation
            strange, counted = strange & (spread <= c.steady_limit), int((spread <= c.steady_limit).sum())
        else:
            counted = len(tile)
        #: In order; the first that holds and isn't left out decides.
        fits = {
            "NIGHT": c.night > 0 and level < c.night,
            "WARMUP": self.seen < c.need,
            "DARK_OBJ": dark >= c.dark_tiles and fresh >= c.dark_tiles,
            "INDIRECT_LIGHT": c.indirect > 0 and level < c.indirect,
            "SPOT_CHANGE": known and abs(since.mean()) < c.spot_still and 1 <= (since < -c.spot_dark).sum() <= c.spot_tiles and (np.abs(since) >= c.spot_noise).sum() <= c.spot_noisy_tiles,
            "QUIET": (strange.sum() / counted if counted else 0.0) <= c.quiet,
            "SCENE_DRIFT": known and dark >= c.drift_tiles and fresh < c.dark_tiles,
        }
        return next((name for name in STAGES if name != without and fits[name]), "AMBIGUOUS")

    def after(self, tile: np.ndarray, stage: str) -> None:
        c = self.c
        if self.seen < c.need or stage == "QUIET" or stage in LEARNED:
            self.mean = (1 - c.alpha) * self.mean + c.alpha * tile
            self.variance = np.maximum((1 - c.alpha) * self.variance + c.alpha * (tile - self.mean) ** 2, c.variance_floor)
        self.seen = 0 if stage == "SCENE_DRIFT" else self.seen + 1
        self.previous = tile


def legacy_cascade(rows: DataFrame, key: str, order: Sequence[str], c: LegacyConfig = LegacyConfig(), without: Sequence[str] = ("",)) -> DataFrame:
    """(key, id, without, trigger, label) of rows (key, id, hour, tile, and `order`), once for each stage of `without` left
    out ('' for none): a frame is decided by its bucket's background before it learns the frame. After a drift the bucket
    warms up anew.

    A null hour counts as 0. Rows without a tile have no result and teach nothing; a key's tiles must be of one size. An
    empty table gives an empty result.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        backgrounds: dict[int, _Background] = {}
        out = []
        for event, hour, values in frame.sort_values(list(order))[["id", "hour", "tile"]].itertuples(index=False):
            tile = np.asarray(values, float)
            bucket = int(hour) * c.buckets // 24
            own = backgrounds.setdefault(bucket, _Background(len(tile), c))
            stage = own.stage(tile, group[1])
            own.after(tile, stage)
            out.append((group[0], event, group[1], stage, "clouds" if stage == "QUIET" else "process"))
        return pd.DataFrame(out, columns=[key, "id", "without", "trigger", "label"])

    dealt = rows.where("tile IS NOT NULL").withColumn("hour", F.coalesce("hour", F.lit(0))).withColumn("without", F.explode(F.array(*map(F.lit, without))))
    return dealt.groupBy(key, "without").applyInPandas(run, f"{key} {kind}, id long, without string, trigger string, label string")


class _Backgrounds:
    """The backgrounds of one bucket under many configurations at once: a row of cells for each. The frame before is
    the same for all."""

    def __init__(self, cells: int, configs: list[LegacyConfig]):
        column = lambda name: np.array([getattr(c, name) for c in configs])
        self.c = {f.name: column(f.name) for f in fields(LegacyConfig)}
        self.mean = np.repeat(self.c["start_mean"][:, None], cells, 1)
        self.variance = np.repeat(self.c["start_variance"][:, None], cells, 1)
        self.seen, self.previous = np.zeros(len(configs), np.int64), None

    def step(self, tile: np.ndarray) -> np.ndarray:
        """The number of each configuration's stage in STAGES, len(STAGES) for none; the backgrounds then learn the frame."""
        c, level, each = self.c, tile.mean(), lambda name: self.c[name][:, None]
        deviation, off = np.sqrt(self.variance), tile - self.mean
        odd = np.abs(off) / deviation > each("z")
        dark = (odd & (off < -each("dark"))).sum(1)
        known = self.previous is not None
        since = tile - self.previous if known else np.zeros_like(tile)
        fresh = (odd & (since < -each("fresh_dark"))).sum(1) if known else dark
        strange = odd & ((off < 0) | ~each("dark_only"))
        spread = np.where((each("steady") == "rel") & (self.mean > 1), deviation / np.where(self.mean > 1, self.mean, 1.0), deviation)
        counted = (spread <= each("steady_limit")) | (each("steady") == "")
        share = (strange & counted).sum(1) / np.maximum(counted.sum(1), 1)
        sunk = (since < -each("spot_dark")).sum(1)
        noisy = (np.abs(since) >= each("spot_noise")).sum(1)
        every, warming = np.ones(len(self.seen), bool), self.seen < c["need"]
        fits = {
            "NIGHT": (c["night"] > 0) & (level < c["night"]),
            "WARMUP": warming,
            "DARK_OBJ": (dark >= c["dark_tiles"]) & (fresh >= c["dark_tiles"]),
            "INDIRECT_LIGHT": (c["indirect"] > 0) & (level < c["indirect"]),
            "SPOT_CHANGE": known & (abs(since.mean()) < c["spot_still"]) & (sunk >= 1) & (sunk <= c["spot_tiles"]) & (noisy <= c["spot_noisy_tiles"]),
            "QUIET": share <= c["quiet"],
            "SCENE_DRIFT": known & (dark >= c["drift_tiles"]) & (fresh < c["dark_tiles"]),
        }
        stage = np.select([fits[name] & every for name in STAGES], range(len(STAGES)), len(STAGES))
        learns = np.flatnonzero(warming | np.isin(stage, [STAGES.index(name) for name in ("QUIET", *LEARNED)]))
        a = each("alpha")[learns]
        self.mean[learns] = (1 - a) * self.mean[learns] + a * tile
        self.variance[learns] = np.maximum((1 - a) * self.variance[learns] + a * (tile - self.mean[learns]) ** 2, each("variance_floor")[learns])
        self.seen = np.where(stage == STAGES.index("SCENE_DRIFT"), 0, self.seen + 1)
        self.previous = tile
        return stage


def configurations(base: LegacyConfig, grid: dict[str, Sequence]) -> list[LegacyConfig]:
    """Every combination of the grid's values, the last field varying fastest."""
    return [replace(base, **dict(zip(grid, values, strict=True))) for values in product(*grid.values())]


def cascade_sweep(rows: DataFrame, key: str, order: Sequence[str], configs: list[LegacyConfig], chunk: int = 648) -> DataFrame:
    """(config, tp, fn, fp, tn, and frames by stage as one array) of each configuration, by its number, over rows (key, id,
    hour, tile, process, and `order`): process tells whether a frame is to be kept. Each is the cascade of `legacy_cascade`
    under that configuration, but a key's frames are folded for a whole chunk of configurations at once, so a step is some
    vector operations. Rows go to as many tasks as keys times chunks; their counts are summed up.
    """
    chunks = -(-len(configs) // chunk)

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = configs[group[1] * chunk : (group[1] + 1) * chunk]
        backgrounds: dict[int, _Backgrounds] = {}
        counts = np.zeros((2, len(own), len(STAGES) + 1), np.int64)
        by_buckets = np.array([c.buckets for c in own])
        sets = [(n, np.flatnonzero(by_buckets == n)) for n in np.unique(by_buckets)]
        for hour, values, process in frame.sort_values(list(order))[["hour", "tile", "process"]].itertuples(index=False):
            tile = np.asarray(values, float)
            for n, some in sets:
                bucket = (int(n), int(hour) * int(n) // 24)
                if bucket not in backgrounds:
                    backgrounds[bucket] = _Backgrounds(len(tile), [own[k] for k in some])
                counts[int(process), some, backgrounds[bucket].step(tile)] += 1
        quiet = STAGES.index("QUIET")
        kept, lost = counts.sum(2) - counts[:, :, quiet], counts[:, :, quiet]
        first = group[1] * chunk
        return pd.DataFrame({"config": range(first, first + len(own)), "tp": kept[1], "fn": lost[1], "fp": kept[0], "tn": lost[0], "stages": counts.sum(0).tolist()})

    dealt = rows.where("tile IS NOT NULL").withColumn("hour", F.coalesce("hour", F.lit(0))).withColumn("process", F.coalesce("process", F.lit(False))).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = dealt.groupBy(key, "__chunk").applyInPandas(run, "config int, tp long, fn long, fp long, tn long, stages array<long>")
    each = [F.sum(F.col("stages")[k]).alias(f"__{k}") for k in range(len(STAGES) + 1)]
    sums = found.groupBy("config").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")], *each)
    return sums.select("config", "tp", "fn", "fp", "tn", F.array(*[f"__{k}" for k in range(len(STAGES) + 1)]).alias("stages"))
