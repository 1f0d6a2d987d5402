"""Rule cascades: the first stage that fits gives label and trigger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(stages: list[tuple[Column, str, str]], otherwise: tuple[str, str]) -> Column:
    """struct(label, trigger) of the first (condition, label, trigger) that holds; a null condition doesn't."""
    make = lambda label, trigger: F.struct(F.lit(label).alias("label"), F.lit(trigger).alias("trigger"))
    out = None
    for condition, label, trigger in stages:
        out = F.when(condition, make(label, trigger)) if out is None else out.when(condition, make(label, trigger))
    return out.otherwise(make(*otherwise))


def photo_bucket(brightness: Column, bright: int = 160, low: int = 80) -> Column:
    return F.when(brightness >= bright, "BRIGHT").when(brightness < low, "LOWLIGHT").otherwise("NORMAL")


@dataclass(frozen=True)
class BurstConfig:
    """The published thresholds, in brightness steps of 0 to 255, seconds and tiles."""

    window: float = 180.0
    brightness: float = 12.0
    tile: float = 12.0
    dark: float = 12.0
    duplicate_tiles: int = 0
    diffuse_tiles: int = 60
    fast_seconds: float = 15.0
    fast_brightness: float = 120.0
    stable_brightness: float = 160.0
    stable_dark: int = 35
    chroma_sq: float = 64.0
    night: float = 70.0


def burst_stages(c: BurstConfig, firmware: bool = False, minimal: bool = False) -> list[tuple[Column, str, str]]:
    """Over prev_gm, dt, gm, gm_diff, n_changed, n_dark, n_chroma. The firmware knows no times and tells night last; the
    minimal filter suppresses duplicates alone."""
    col = F.col
    first = (col("prev_gm").isNull() | col("dt").isNull() | (col("dt") == float("inf")), "process", "FIRST")
    isolated = (col("dt") > c.window, "process", "ISOLATED")
    shift = col("gm_diff") > c.brightness
    fast = (shift & (col("dt") < c.fast_seconds) & (col("gm") >= c.fast_brightness), "suppress", "FAST_SHIFT")
    duplicate = ((col("n_changed") <= c.duplicate_tiles) & (col("n_chroma") == 0), "suppress", "DUPLICATE")
    stable = ((col("gm") > c.stable_brightness) & (col("n_dark") < c.stable_dark), "suppress", "BRIGHT_STABLE")
    night = (col("gm") < c.night, "process", "NIGHT")
    diffuse = (col("n_dark") >= c.diffuse_tiles, "suppress", "DIFFUSE")
    if minimal:
        return [first, isolated, duplicate]
    if firmware:
        return [(col("prev_gm").isNull(), "process", "FIRST"), (shift, "process", "BRIGHTNESS_SHIFT"), duplicate, stable, diffuse, night]
    return [first, isolated, fast, (shift, "process", "BRIGHTNESS_SHIFT"), duplicate, stable, night, diffuse]


def burst_filter(c: BurstConfig = BurstConfig(), firmware: bool = False, minimal: bool = False) -> Column:
    return first_match(burst_stages(c, firmware, minimal), ("process", "SAFE"))


def routed(burst: Column) -> Column:
    """Only these two triggers keep a frame from the background classifier."""
    return F.when(burst["trigger"].isin("DUPLICATE", "BRIGHT_STABLE"), "clouds").when(burst["trigger"] == "NIGHT", "process").otherwise("classify")
