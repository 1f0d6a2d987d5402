"""Decision pipelines over grids: kernel, mask, blob, cascade.

Each takes rows with a frame's grid, its model and its time and gives the figures and the decision for each. Grids stay
arrays of one row, so nothing but the previous frame of a key is shuffled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.operators import cascades as C
from tidemark.operators import grid as G


@dataclass(frozen=True)
class Shape:
    h: int
    w: int


def with_previous(rows: DataFrame, key: str, order: list[str], planes: list[str]) -> DataFrame:
    """prev_<plane> of the key's frame before, null for its first, and frame: its number from 1. A key's rows are sorted by
    one task, so keys are devices or spans of them."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select("*", *[F.lag(p).over(w).alias(f"prev_{p}") for p in planes], F.row_number().over(w).alias("frame"))


def burst_figures(rows: DataFrame, c: C.BurstConfig = C.BurstConfig()) -> DataFrame:
    """gm, prev_gm, gm_diff, n_changed, n_dark, n_chroma of a frame (tile, u, v) against the one before (prev_tile, prev_u,
    prev_v), as `cascades.burst_filter` reads them; the counts are 0 for a first frame."""
    whole = lambda a: F.floor(G.mean(F.col(a)))
    count = lambda a: F.coalesce(F.when(F.col("prev_tile").isNotNull(), a), F.lit(0)).cast("long")
    gap = F.zip_with("tile", "prev_tile", lambda x, p: x - p)
    chroma = G.chroma_sq(F.col("u"), F.col("v"), F.col("prev_u"), F.col("prev_v"), centred=False)
    out = rows.select("*", whole("tile").alias("gm"), whole("prev_tile").alias("prev_gm"))
    return out.select(
        "*", F.abs(F.col("gm") - F.col("prev_gm")).alias("gm_diff"), count(G.count_where(gap, lambda d: F.abs(d) > c.tile)).alias("n_changed"),
        count(G.count_where(gap, lambda d: d < -c.dark)).alias("n_dark"), count(G.count_where(chroma, lambda d: d > c.chroma_sq)).alias("n_chroma"),
    )


def high_pass_pipeline(rows: DataFrame, s: Shape, radius: int = 1, threshold: float = 25.0, chroma: float = 8.0, chroma_floor: float = 10.0, night: float = 70.0) -> DataFrame:
    """hp_score, hp_tiles, hp_chroma_tiles, stage, result of rows with tile, model, delta_chroma, gm and burst (a trigger).
    Night and duplicates are told before the high pass, whose two channels are the cells far darker than their surroundings
    and those whose colour changed and that are somewhat darker."""
    out = rows.withColumn("hp", G.high_pass(F.col("tile"), F.col("model"), s.h, s.w, radius))
    both = F.zip_with("hp", "delta_chroma", lambda d, x: (x >= chroma) & (d >= chroma_floor))
    out = out.withColumn("hp_tiles", G.count_where(F.col("hp"), lambda d: d >= threshold).cast("long")).withColumn("hp_chroma_tiles", F.coalesce(G.count_where(both, lambda m: m), F.lit(0)).cast("long"))
    stages = [(F.col("gm") < night, "process", "NIGHT"), (F.col("burst") == "DUPLICATE", "clouds", "DUPLICATE"), ((F.col("hp_tiles") >= 1) | (F.col("hp_chroma_tiles") >= 1), "process", "DARK_BLOB_HP")]
    made = C.first_match(stages, ("clouds", "QUIET_HP"))
    return out.withColumn("hp_score", F.array_max("hp")).withColumn("decision", made).select("*", F.col("decision.trigger").alias("stage"), F.col("decision.label").alias("result")).drop("decision", "hp")


def blur_pipeline(rows: DataFrame, s: Shape, radius: int = 1, threshold: float = 25.0) -> DataFrame:
    """hp_score, adjusted (a model whose difference from the tile is the high-pass delta), stage, result of rows with tile,
    model and burst; what the burst filter suppressed is left out."""
    kept = rows.where(~F.coalesce(F.col("burst").isin("DUPLICATE", "BRIGHT_STABLE", "FAST_SHIFT", "DIFFUSE"), F.lit(False)))
    blurred = lambda a: G.box_blur(F.col(a), s.h, s.w, radius, "nearest")
    adjusted = F.zip_with(F.zip_with("model", blurred("model"), lambda m, b: m - b), blurred("tile"), lambda x, b: x + b)
    out = kept.withColumn("adjusted", adjusted).withColumn("hp_score", F.array_max(F.zip_with("adjusted", "tile", lambda a, t: a - t)))
    loud = F.col("hp_score") >= threshold
    return out.select("*", F.when(loud, "DARK_BLOB_HP").otherwise("QUIET_HP").alias("stage"), F.when(loud, "process").otherwise("clouds").alias("result"))


def background_pipeline(rows: DataFrame, s: Shape, z: float = 3.0, blob: tuple[int, int] = (1, 5), quiet: float = 0.25, need: int = 3, dark: float = 12.0, texture: tuple[float, float] | None = None) -> DataFrame:
    """ratio, dark_tiles, dark_blob, warmup, trigger, label of rows with tile, model, variance and frame. Dark anomalies are
    joined to blobs by edges; a compact one is looked for before a quiet scene is. With `texture`, a least roughness and a
    darkness, rows have a grid `rough` too, and texture_blob is the largest blob, by corners, of cells over the one that are
    darker than the model by more than the other; a compact one counts as a dark one does."""
    mask = G.dark_anomalies(F.col("tile"), F.col("model"), F.col("variance"), z)
    out = rows.withColumn("mask", mask).withColumn("ratio", G.share(F.col("mask")))
    deep = F.zip_with(F.zip_with("tile", "model", lambda x, m: x < m - dark), F.col("mask"), lambda a, b: a & b)
    out = out.withColumn("deep", deep).withColumn("dark_tiles", G.count_where(F.col("deep"), lambda m: m).cast("long"))
    out = out.withColumn("dark_blob", let(G.components(F.col("deep"), s.h, s.w, False), G.largest_blob).cast("long")).withColumn("warmup", F.greatest(F.lit(0), need + 1 - F.col("frame")).cast("long"))
    compact = F.col("dark_blob").between(*blob)
    if texture:
        loose = F.zip_with("tile", "model", lambda x, m: x < m - texture[1])
        out = out.withColumn("woven", F.zip_with(F.transform("rough", lambda r: r > texture[0]), loose, lambda a, b: a & b))
        out = out.withColumn("texture_blob", let(G.components(F.col("woven"), s.h, s.w, True), G.largest_blob).cast("long")).drop("woven")
        compact = compact | F.col("texture_blob").between(*blob)
    made = C.first_match([(F.col("warmup") > 0, "process", "WARMUP"), (compact, "process", "DARK_BLOB"), (F.col("ratio") <= quiet, "clouds", "QUIET")], ("process", "AMBIGUOUS"))
    return out.withColumn("decision", made).select("*", F.col("decision.trigger").alias("trigger"), F.col("decision.label").alias("label")).drop("decision", "mask", "deep")


@dataclass(frozen=True)
class PixelConfig:
    """Limits of the pixel pipeline, in the units of its channels; big: share of a frame that is no bird's any more."""

    cd_z: float = 6.0
    ad_z: float = 6.0
    occlusion: float = 0.35
    structure: float = 2.0
    night: float = 30.0
    warmup: int = 3
    novelty: float = 0.6
    big: float = 0.04
    least_area: int = 2
    bump: float = 6.0


def pixel_pipeline(rows: DataFrame, s: Shape, c: PixelConfig = PixelConfig()) -> DataFrame:
    """n_blobs, max_blob, top, channel, decision of rows with tile, model, cd_mean, cd_sd, ad_mean, ad_sd, hf_mean (each a
    grid or one value for all cells), regime_distance, frame, shift and bumped.

    The frame is scaled to its model (brightness distortion); what is left in colour and what is darker than the scale of
    its surroundings are measured in deviations that these cells have had; where a background has structure, darkness must
    hide it. The larger channel, smoothed, is cut at 1 into blobs with corners."""
    grid_of = lambda name: F.col(name) if rows.schema[name].dataType.typeName() == "array" else F.array_repeat(F.col(name), s.h * s.w)
    blur = lambda a, k: G.box_blur(a, s.h, s.w, k, "reflect")
    alpha = F.zip_with("tile", "model", lambda x, m: x / F.greatest(m, F.lit(1.0)))
    out = rows.withColumn("alpha", alpha).withColumn("around", blur(F.col("alpha"), 2))
    whole = G.total(F.zip_with("tile", "model", lambda x, m: x * m)) / F.greatest(G.total(F.transform("model", lambda m: m * m)), F.lit(1.0))
    out = out.withColumn("scale", whole).withColumn("cd", F.zip_with("tile", "model", lambda x, m: F.abs(x - F.col("scale") * m)))
    out = out.withColumn("ad", F.zip_with("around", "alpha", lambda b, a: F.greatest(F.lit(0.0), b - a)))
    out = out.withColumn("hf", F.zip_with("tile", blur(F.col("tile"), 1), lambda x, b: F.abs(x - b)))
    scored = lambda value, mean, sd: F.zip_with(F.zip_with(value, grid_of(mean), lambda x, m: x - m), grid_of(sd), lambda x, d: x / d)
    expected = F.zip_with("around", grid_of("hf_mean"), lambda b, m: F.greatest(b, F.lit(0.05)) * m + 1e-3)
    hidden = F.zip_with("hf", expected, lambda h, e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / e)))
    clear = F.zip_with(hidden, grid_of("hf_mean"), lambda o, m: (m <= c.structure) | (o > c.occlusion))
    out = out.withColumn("chroma", F.transform(scored("cd", "cd_mean", "cd_sd"), lambda x: x / c.cd_z))
    out = out.withColumn("bright", F.zip_with(scored("ad", "ad_mean", "ad_sd"), clear, lambda x, ok: F.when(ok, x).otherwise(0.0) / c.ad_z))
    out = out.withColumn("score", blur(F.zip_with("chroma", "bright", lambda a, b: F.greatest(a, b)), 1))
    fired = F.transform("score", lambda x: x > 1.0)
    out = out.withColumn("sizes", let(G.components(fired, s.h, s.w, True), G.blob_sizes)).withColumn("top", F.array_max("score"))
    out = out.withColumn("n_blobs", G.count_where(F.col("sizes"), lambda n: n >= c.least_area).cast("long")).withColumn("max_blob", F.coalesce(F.array_max("sizes"), F.lit(0)).cast("long"))
    by = F.filter(F.zip_with("score", "chroma", lambda x, k: F.when(x > 1.0, (k > 1.0).cast("double"))), lambda x: x.isNotNull())
    out = out.withColumn("by", by).withColumn("channel", F.when(F.size("by") == 0, "-").when(G.mean(F.col("by")) > 0.5, "chroma").otherwise("bright"))
    stages = [
        (G.mean(F.col("tile")) < c.night, "skip", "NIGHT"), (F.col("frame") <= c.warmup, "skip", "WARMUP"), (F.col("bumped") & (F.col("shift") > c.bump), "skip", "BUMP"),
        (F.col("regime_distance") > c.novelty, "keep", "SCENE_EVENT"), (F.col("max_blob") > c.big * s.h * s.w, "keep", "SCENE_EVENT"), (F.col("n_blobs") >= 1, "keep", "BIRD_CANDIDATE"),
    ]
    return out.withColumn("decision", C.first_match(stages, ("skip", "BACKGROUND"))["trigger"]).drop("alpha", "around", "scale", "cd", "ad", "hf", "chroma", "bright", "score", "sizes", "by")


def blob_score(field: Column, s: Shape, percentiles: tuple[float, ...] = (99.0, 99.5, 99.9), area: tuple[int, int] = (15, 800)) -> Column:
    """The best mean of the field over a blob (with corners) whose area lies in a band, of the cells above any of some of
    the field's own percentiles; 0 without one."""

    def of(sorted_: Column) -> Column:
        best = [F.lit(0.0)]
        for p in percentiles:
            place = (F.size(sorted_) - 1) * (p / 100)
            low = F.element_at(sorted_, F.floor(place).cast("int") + 1)
            high = F.element_at(sorted_, F.least(F.floor(place).cast("int") + 2, F.size(sorted_)))
            cut = low + (high - low) * (place - F.floor(place))

            def means(labels: Column) -> Column:
                blobs = F.array_distinct(F.filter(labels, lambda x: x > 0))
                inside = lambda b: F.filter(F.zip_with(labels, field, lambda k, x: F.when(k == b, x)), lambda x: x.isNotNull())
                own = F.transform(blobs, lambda b: let(inside(b), lambda v: F.when(F.size(v).between(*area), G.mean(v))))
                return F.coalesce(F.array_max(own), F.lit(0.0))

            best.append(let(cut, lambda t: let(G.components(F.transform(field, lambda x: x > t), s.h, s.w, True), means)))
        return F.greatest(*best)

    return let(F.sort_array(F.transform(field, lambda x: x.cast("double"))), of)
