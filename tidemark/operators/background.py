"""Adaptive background statistics of each cell: ordered folds with decision feedback.

The state of a cell depends on decisions that depend on the state, which no window expresses. A batch folds the ordered
array of one key's frames; a key is a device and a day or another bounded span, so that an array stays within a row's
reach. Streams use streaming.background."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EmaConfig:
    """The published rates and floors."""

    alpha: float = 0.15
    floor: float = 36.0
    start_mean: float = 128.0
    start_variance: float = 256.0


def ema_step(mean: Column, variance: Column, x: Column, c: EmaConfig) -> tuple[Column, Column]:
    """The variance takes the residual after the mean has moved."""
    new = (1 - c.alpha) * mean + c.alpha * x
    return new, F.greatest((1 - c.alpha) * variance + c.alpha * (x - new) * (x - new), F.lit(c.floor))


def west_step(mean: Column, variance: Column, x: Column, c: EmaConfig) -> tuple[Column, Column]:
    """The variance takes the residual before: v' = (1 - a)(v + a d d). Another estimator, not another spelling."""
    d = x - mean
    return mean + c.alpha * d, (1 - c.alpha) * (variance + c.alpha * d * d)


def folded(values: Column, step=ema_step, c: EmaConfig = EmaConfig()) -> Column:
    """struct(mean, variance) after an ordered array of one cell's values."""

    def run(s: Column, x: Column) -> Column:
        mean, variance = step(s["mean"], s["variance"], x, c)
        return F.struct(mean.alias("mean"), variance.alias("variance"))

    return F.aggregate(values, F.struct(F.lit(c.start_mean).alias("mean"), F.lit(c.start_variance).alias("variance")), run)


def scored(events: Column, z: float, c: EmaConfig = EmaConfig()) -> Column:
    """For an ordered array of struct(id, x, teaches): array of struct(id, mean, z, anomalous), each scored by the state
    before it; an event teaches if it may and is not anomalous itself, or the cell is new."""

    def run(s: Column, e: Column) -> Column:
        score = F.abs(e["x"] - s["mean"]) / F.sqrt(s["variance"])
        odd = (score > z) & (s["count"] > 0)
        mean, variance = ema_step(s["mean"], s["variance"], e["x"], c)
        learn = e["teaches"] & ~odd
        own = F.struct(e["id"].alias("id"), s["mean"].alias("mean"), score.alias("z"), odd.alias("anomalous"))
        return F.struct(
            F.when(learn, mean).otherwise(s["mean"]).alias("mean"), F.when(learn, variance).otherwise(s["variance"]).alias("variance"),
            F.least(s["count"] + learn.cast("int"), F.lit(65535)).alias("count"), F.concat(s["out"], F.array(own)).alias("out"),
        )

    none = F.array().cast("array<struct<id:bigint,mean:double,z:double,anomalous:boolean>>")
    start = F.struct(F.lit(c.start_mean).alias("mean"), F.lit(c.start_variance).alias("variance"), F.lit(0).alias("count"), none.alias("out"))
    return F.aggregate(events, start, run, lambda s: s["out"])
