"""Queries of whole decision pipelines, from kernels to cascades, over sequences of grids."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.operators import cascades as C
from tidemark.operators import grid as G
from tidemark.operators import legacy
from tidemark.operators import pipelines as P
from tidemark.plans.grids import _CELLS, _MODEL, H, W, _blur, _grids, _joined
from tidemark.registry import query
from tidemark.sources.frames import FRAMES, frames

SHAPE = P.Shape(H, W)
#: Grids of one label are a device's frames by id. The fixture has one plane; two more are made of it.
_BURSTS = C.BurstConfig(brightness=6.0, tile=60.0, dark=25.0, duplicate_tiles=1, chroma_sq=10_000.0, stable_brightness=130.0, stable_dark=14, diffuse_tiles=20, night=120.0)
_FRAME = f"""{_MODEL}, o AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY id) AS frame, lag(id) OVER (PARTITION BY label ORDER BY id) AS prev FROM (SELECT DISTINCT id, label FROM g)),
q AS (SELECT j.id, j.label, j.i, j.x, j.m, p.x AS px, o.frame FROM j JOIN o ON o.id = j.id LEFT JOIN g p ON p.id = o.prev AND p.i = j.i),
f AS (SELECT id, label, any_value(frame) AS frame, floor(avg(x)) AS gm, floor(avg(px)) AS prev_gm, abs(floor(avg(x)) - floor(avg(px))) AS gm_diff, count(*) FILTER (abs(x - px) > 60) AS n_changed, count(*) FILTER (x - px < -25) AS n_dark,
  count(*) FILTER (power((x - px) / 2, 2) + power((x - px) / 4, 2) > 10000) AS n_chroma FROM q GROUP BY id, label),
u AS (SELECT *, CASE WHEN prev_gm IS NULL THEN 'FIRST' WHEN gm_diff > 6 THEN 'BRIGHTNESS_SHIFT' WHEN n_changed <= 1 AND n_chroma = 0 THEN 'DUPLICATE' WHEN gm > 130 AND n_dark < 14 THEN 'BRIGHT_STABLE' WHEN n_dark >= 20 THEN 'DIFFUSE' WHEN gm < 120 THEN 'NIGHT' ELSE 'SAFE' END AS burst FROM f)"""


def _sequence(spark, sf_dir):
    rows = _joined(spark, sf_dir).withColumn("u", F.transform("tile", lambda x: x / 2)).withColumn("v", F.transform("tile", lambda x: x / 4))
    found = P.burst_figures(P.with_previous(rows, "label", ["id"], ["tile", "u", "v"]), _BURSTS)
    return found.withColumn("burst", C.burst_filter(_BURSTS, firmware=True)["trigger"])


@query("burst_pipeline", f"WITH {_FRAME} SELECT id, CAST(gm AS BIGINT) AS gm, n_changed, n_dark, n_chroma, burst FROM u")
def burst_pipeline(spark, sf_dir):
    """D02 from its kernels: each grid against the one before of its device."""
    return _sequence(spark, sf_dir).select("id", "gm", "n_changed", "n_dark", "n_chroma", "burst")


#: The fixture's frames lie minutes to hours apart.
_TIMED = replace(_BURSTS, window=7200.0, fast_seconds=900.0)
_SHIFT = "gm_diff > 6"
_REPEAT = "n_changed <= 1 AND n_chroma = 0"


@query(
    "timed_bursts",
    f"""WITH {FRAMES}, {_CELLS}, o AS (SELECT s.id, t.us, lag(s.id) OVER w AS prev, lag(t.us) OVER w AS prev_us FROM (SELECT DISTINCT id, label FROM g) s JOIN frames t ON t.id = s.id WINDOW w AS (PARTITION BY s.label ORDER BY t.us, s.id)),
q AS (SELECT g.id, g.x, p.x AS px, (o.us - o.prev_us) / 1e6 AS dt FROM g JOIN o ON o.id = g.id LEFT JOIN g p ON p.id = o.prev AND p.i = g.i),
f AS (SELECT id, any_value(dt) AS dt, floor(avg(x)) AS gm, floor(avg(px)) AS prev_gm, abs(floor(avg(x)) - floor(avg(px))) AS gm_diff, count(*) FILTER (abs(x - px) > 60) AS n_changed, count(*) FILTER (x - px < -25) AS n_dark, count(*) FILTER (power((x - px) / 2, 2) + power((x - px) / 4, 2) > 10000) AS n_chroma FROM q GROUP BY id),
d AS (SELECT id, dt, CASE WHEN prev_gm IS NULL THEN 'FIRST' WHEN dt > 7200 THEN 'ISOLATED' WHEN {_SHIFT} AND dt < 900 AND gm >= 120 THEN 'FAST_SHIFT' WHEN {_SHIFT} THEN 'BRIGHTNESS_SHIFT' WHEN {_REPEAT} THEN 'DUPLICATE' WHEN gm > 130 AND n_dark < 14 THEN 'BRIGHT_STABLE' WHEN gm < 120 THEN 'NIGHT' WHEN n_dark >= 20 THEN 'DIFFUSE' ELSE 'SAFE' END AS timed,
  CASE WHEN prev_gm IS NULL THEN 'FIRST' WHEN dt > 7200 THEN 'ISOLATED' WHEN {_REPEAT} THEN 'DUPLICATE' ELSE 'SAFE' END AS minimal FROM f)
SELECT id, round(dt, 6) AS dt, timed, minimal, CASE WHEN timed IN ('DUPLICATE', 'BRIGHT_STABLE') THEN 'clouds' WHEN timed = 'NIGHT' THEN 'process' ELSE 'classify' END AS route FROM d""",
)
def timed_bursts(spark, sf_dir):
    """D01, D03, D11 from their kernels: each grid against the one before of its label, at the time of the event of its id."""
    times = frames(spark, sf_dir).select("id", "us")
    grids = _grids(spark, sf_dir).withColumn("u", F.transform("tile", lambda x: x / 2)).withColumn("v", F.transform("tile", lambda x: x / 4))
    rows = P.with_previous(grids.join(times, "id"), "label", ["us", "id"], ["tile", "u", "v", "us"])
    found = P.burst_figures(rows, _TIMED).withColumn("dt", (F.col("us") - F.col("prev_us")) / 1e6)
    full = C.burst_filter(_TIMED)
    return found.select("id", F.round("dt", 6).alias("dt"), full["trigger"].alias("timed"), C.burst_filter(_TIMED, minimal=True)["trigger"].alias("minimal"), C.routed(full).alias("route"))


_HP = f"""{_FRAME}, {_blur("nearest")}, mm AS (SELECT id, i, m AS x FROM j), mb AS ({_blur("nearest")[6:-1].replace("FROM g c", "FROM mm c").replace("JOIN g n", "JOIN mm n")}),
hp AS (SELECT j.id, j.i, j.x, j.m, (j.m - mb.b) - (j.x - b.b) AS d, j.m - mb.b + b.b AS adjusted FROM j JOIN b USING (id, i) JOIN mb USING (id, i))"""


@query(
    "high_pass_pipeline",
    f"""WITH {_HP}, s AS (SELECT id, round(max(d), 5) AS hp_score, count(*) FILTER (d >= 60) AS hp_tiles, count(*) FILTER (abs(x - m) / 2 >= 20 AND d >= 50) AS hp_chroma_tiles FROM hp GROUP BY id)
SELECT id, hp_score, hp_tiles, hp_chroma_tiles, CASE WHEN gm < 120 THEN 'NIGHT' WHEN burst = 'DUPLICATE' THEN 'DUPLICATE' WHEN hp_tiles >= 1 OR hp_chroma_tiles >= 1 THEN 'DARK_BLOB_HP' ELSE 'QUIET_HP' END AS stage,
CASE WHEN gm < 120 THEN 'process' WHEN burst = 'DUPLICATE' THEN 'clouds' WHEN hp_tiles >= 1 OR hp_chroma_tiles >= 1 THEN 'process' ELSE 'clouds' END AS result FROM s JOIN u USING (id)""",
)
def high_pass_pipeline(spark, sf_dir):
    """D05 from its kernels."""
    rows = _sequence(spark, sf_dir).withColumn("delta_chroma", F.zip_with("tile", "model", lambda x, m: F.abs(x - m) / 2))
    out = P.high_pass_pipeline(rows, SHAPE, threshold=60.0, chroma=20.0, chroma_floor=50.0, night=120.0)
    return out.select("id", F.round("hp_score", 5).alias("hp_score"), "hp_tiles", "hp_chroma_tiles", "stage", "result")


@query(
    "blur_pipeline",
    f"""WITH {_HP}, s AS (SELECT id, max(d) AS top, round(sum(adjusted * (i + 1)), 3) AS adjusted FROM hp GROUP BY id)
SELECT id, round(top, 5) AS hp_score, adjusted, CASE WHEN top >= 55 THEN 'DARK_BLOB_HP' ELSE 'QUIET_HP' END AS stage, CASE WHEN top >= 55 THEN 'process' ELSE 'clouds' END AS result FROM s JOIN u USING (id) WHERE burst NOT IN ('DUPLICATE', 'BRIGHT_STABLE', 'FAST_SHIFT', 'DIFFUSE')""",
)
def blur_pipeline(spark, sf_dir):
    """D06 from its kernels; the adjusted model as a place-weighted sum."""
    out = P.blur_pipeline(_sequence(spark, sf_dir), SHAPE, threshold=55.0)
    weighed = G.total(F.transform("adjusted", lambda x, i: x * (i + 1)))
    return out.select("id", F.round("hp_score", 5).alias("hp_score"), F.round(weighed, 3).alias("adjusted"), "stage", "result")


def _reach(mask: str, near: str, n: str = "") -> str:
    """Blob numbers of the cells in `mask` (id, i), for twins; `n` tells the tables of one mask from another's."""
    return f"""e{n} AS (SELECT a.id, a.i, b.i AS to_i FROM {mask} a JOIN {mask} b ON a.id = b.id AND {near}), r{n} AS (SELECT id, i, i AS to_i FROM {mask} UNION SELECT r.id, r.i, e.to_i FROM r{n} r JOIN e{n} e ON r.id = e.id AND r.to_i = e.i),
l{n} AS (SELECT id, i, min(to_i) AS blob FROM r{n} GROUP BY id, i), z{n} AS (SELECT id, blob, count(*) AS n FROM l{n} GROUP BY id, blob)"""


_EDGES = "abs(a.i // 8 - b.i // 8) + abs(a.i % 8 - b.i % 8) <= 1"
_CORNERS = "abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1"


@query(
    "background_pipeline",
    f"""WITH RECURSIVE {_FRAME}, d AS (SELECT id, i FROM j WHERE abs(x - m) / 20.0 > 1.8 AND x < m AND x < m - 38), {_reach("d", _EDGES)},
w AS (SELECT id, avg(CAST(abs(x - m) / 20.0 > 1.8 AND x < m AS INTEGER)) AS ratio FROM j GROUP BY id), t AS (SELECT id, coalesce(sum(n), 0) AS dark_tiles, coalesce(max(n), 0) AS dark_blob FROM (SELECT DISTINCT id FROM j) LEFT JOIN z USING (id) GROUP BY id)
SELECT id, round(ratio, 6) AS ratio, CAST(dark_tiles AS BIGINT) AS dark_tiles, CAST(dark_blob AS BIGINT) AS dark_blob, greatest(0, 4 - frame) AS warmup,
CASE WHEN frame < 4 THEN 'WARMUP' WHEN dark_blob BETWEEN 3 AND 5 THEN 'DARK_BLOB' WHEN ratio <= 0.06 THEN 'QUIET' ELSE 'AMBIGUOUS' END AS trigger,
CASE WHEN frame >= 4 AND NOT dark_blob BETWEEN 3 AND 5 AND ratio <= 0.06 THEN 'clouds' ELSE 'process' END AS label FROM w JOIN t USING (id) JOIN u USING (id)""",
)
def background_pipeline(spark, sf_dir):
    """D04 from its kernels: anomalies, blobs by edges, warm-up by place in the device's frames."""
    rows = _sequence(spark, sf_dir).withColumn("variance", F.array_repeat(F.lit(400.0), H * W)).drop("label")
    out = P.background_pipeline(rows, SHAPE, z=1.8, blob=(3, 5), quiet=0.06, dark=38.0)
    return out.select("id", F.round("ratio", 6).alias("ratio"), "dark_tiles", "dark_blob", "warmup", "trigger", "label")


def _blur_of(name: str, column: str, k: int) -> str:
    """The mean of the (2 k + 1)-square around each cell of a table (id, i, column), mirrored at the edges."""
    side = 2 * k + 1
    at = lambda e: f"(CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} > 7 THEN 15 - ({e}) ELSE {e} END)"
    return f"SELECT c.id, c.i, avg(n.{column}) AS b FROM {name} c CROSS JOIN (SELECT y - {k} AS dy, x - {k} AS dx FROM range({side}) a(y), range({side}) b(x)) o JOIN {name} n ON n.id = c.id AND n.i = {at('c.i // 8 + dy')} * 8 + {at('c.i % 8 + dx')} GROUP BY c.id, c.i"


_TEXTURED = """SELECT id, round(ratio, 6) AS ratio, CAST(dark_blob AS BIGINT) AS dark_blob, CAST(texture_blob AS BIGINT) AS texture_blob,
CASE WHEN frame < 4 THEN 'WARMUP' WHEN dark_blob BETWEEN 3 AND 5 OR texture_blob BETWEEN 3 AND 5 THEN 'DARK_BLOB' WHEN ratio <= 0.06 THEN 'QUIET' ELSE 'AMBIGUOUS' END AS trigger"""


@query(
    "textured_background",
    f"""WITH RECURSIVE {_FRAME}, d AS (SELECT id, i FROM j WHERE abs(x - m) / 20.0 > 1.8 AND x < m AND x < m - 38), {_reach("d", _EDGES)},
soft AS ({_blur_of("j", "x", 1)}), woven AS (SELECT j.id, j.i FROM j JOIN soft ON soft.id = j.id AND soft.i = j.i WHERE abs(x - b) > 25 AND x < m - 20), {_reach("woven", _CORNERS, "2")},
w AS (SELECT id, avg(CAST(abs(x - m) / 20.0 > 1.8 AND x < m AS INTEGER)) AS ratio FROM j GROUP BY id),
t AS (SELECT id, coalesce(max(z.n), 0) AS dark_blob FROM w LEFT JOIN z USING (id) GROUP BY id), t2 AS (SELECT id, coalesce(max(z2.n), 0) AS texture_blob FROM w LEFT JOIN z2 USING (id) GROUP BY id)
{_TEXTURED} FROM w JOIN t USING (id) JOIN t2 USING (id) JOIN u USING (id)""",
)
def textured_background(spark, sf_dir):
    """D04 with its second signal: blobs of rough, somewhat dark cells beside the dark ones."""
    rough = F.zip_with("tile", G.box_blur(F.col("tile"), H, W, 1, "reflect"), lambda x, b: F.abs(x - b))
    rows = _sequence(spark, sf_dir).withColumn("variance", F.array_repeat(F.lit(400.0), H * W)).withColumn("rough", rough).drop("label")
    out = P.background_pipeline(rows, SHAPE, z=1.8, blob=(3, 5), quiet=0.06, dark=38.0, texture=(25.0, 20.0))
    return out.select("id", F.round("ratio", 6).alias("ratio"), "dark_blob", "texture_blob", "trigger")


_PIXEL = P.PixelConfig(cd_z=1.5, ad_z=1.5, occlusion=0.2, structure=10.0, night=118.0, novelty=0.012, big=0.2, least_area=2, bump=2.0)


@query(
    "pixel_pipeline",
    f"""WITH RECURSIVE {_FRAME}, s0 AS (SELECT id, sum(x * m) / greatest(sum(m * m), 1) AS k FROM j GROUP BY id), a0 AS (SELECT id, i, x, m, x / greatest(m, 1) AS al FROM j),
ab AS ({_blur_of("a0", "al", 2)}), xb AS ({_blur_of("a0", "x", 1)}), c0 AS (SELECT a0.id, a0.i, (abs(x - k * m) - 10) / 12 / 1.5 AS chroma, (greatest(0, ab.b - al) - 0.1) / 0.1 AS z, ab.b AS around, abs(x - xb.b) AS hf FROM a0 JOIN ab USING (id, i) JOIN xb USING (id, i) JOIN s0 USING (id)),
c1 AS (SELECT id, i, chroma, greatest(chroma, CASE WHEN greatest(0, least(1, 1 - hf / (greatest(around, 0.05) * 16.0 + 1e-3))) > 0.2 THEN z ELSE 0 END / 1.5) AS top FROM c0), sc AS ({_blur_of("c1", "top", 1)}),
d AS (SELECT id, i FROM sc WHERE b > 1.0), {_reach("d", _CORNERS)}, h AS (SELECT sc.id, max(b) AS top, avg(CASE WHEN b > 1.0 THEN CAST(chroma > 1.0 AS INTEGER) END) AS by_chroma FROM sc JOIN c1 USING (id, i) GROUP BY sc.id),
n AS (SELECT id, count(n) FILTER (n >= 2) AS n_blobs, coalesce(max(n), 0) AS max_blob FROM (SELECT DISTINCT id FROM j) LEFT JOIN z USING (id) GROUP BY id),
y AS (SELECT id, avg(x) AS gm, abs(avg(x) - avg(m)) / 255 AS rd, any_value(frame) AS frame FROM q GROUP BY id)
SELECT id, n_blobs, max_blob, round(top, 5) AS top, CASE WHEN by_chroma IS NULL THEN '-' WHEN by_chroma > 0.5 THEN 'chroma' ELSE 'bright' END AS channel,
CASE WHEN gm < 118 THEN 'NIGHT' WHEN frame <= 3 THEN 'WARMUP' WHEN id % 3 = 0 AND id % 5 > 2 THEN 'BUMP' WHEN rd > 0.012 THEN 'SCENE_EVENT' WHEN max_blob > 12.8 THEN 'SCENE_EVENT' WHEN n_blobs >= 1 THEN 'BIRD_CANDIDATE' ELSE 'BACKGROUND' END AS decision
FROM n JOIN h USING (id) JOIN y USING (id)""",
)
def pixel_pipeline(spark, sf_dir):
    """D07 from its kernels. Shifts and their confirmation come from `camera_shifts` and `bump_confirmation` and stand
    beside the grids here; a regime's distance is that of the means."""
    rows = P.with_previous(_joined(spark, sf_dir), "label", ["id"], ["tile"])
    fixed = {"cd_mean": 10.0, "cd_sd": 12.0, "ad_mean": 0.1, "ad_sd": 0.1, "hf_mean": 16.0}
    rows = rows.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()], (F.abs(G.mean(F.col("tile")) - G.mean(F.col("model"))) / 255).alias("regime_distance"), (F.col("id") % 5).cast("double").alias("shift"), (F.col("id") % 3 == 0).alias("bumped"))
    return P.pixel_pipeline(rows, SHAPE, _PIXEL).select("id", "n_blobs", "max_blob", F.round("top", 5).alias("top"), "channel", "decision")


def _score_at(p: float) -> str:
    return f"SELECT id, {p} AS p, i, d FROM f0 JOIN (SELECT id, quantile_cont(d, {p / 100}) AS cut FROM f0 GROUP BY id) USING (id) WHERE d > cut"


@query(
    "blob_scores",
    f"""WITH RECURSIVE {_MODEL}, f0 AS (SELECT id, i, CAST(abs(x - m) AS DOUBLE) AS d FROM j), k AS ({" UNION ALL ".join(map(_score_at, (75.0, 85.0, 92.0)))}),
e AS (SELECT a.id, a.p, a.i, b.i AS to_i FROM k a JOIN k b ON a.id = b.id AND a.p = b.p AND {_CORNERS}), r AS (SELECT id, p, i, i AS to_i FROM k UNION SELECT r.id, r.p, r.i, e.to_i FROM r JOIN e ON r.id = e.id AND r.p = e.p AND r.to_i = e.i),
l AS (SELECT id, p, i, min(to_i) AS blob FROM r GROUP BY id, p, i), s AS (SELECT id, p, blob, count(*) AS n, avg(d) AS mean FROM l JOIN k USING (id, p, i) GROUP BY id, p, blob)
SELECT id, round(coalesce(max(mean) FILTER (n BETWEEN 2 AND 6), 0), 5) AS score FROM (SELECT DISTINCT id FROM j) LEFT JOIN s USING (id) GROUP BY id""",
)
def blob_scores(spark, sf_dir):
    """The best compact blob above a frame's own percentiles."""
    field = F.zip_with("tile", "model", lambda x, m: F.abs(x - m).cast("double"))
    rows = _joined(spark, sf_dir).select("id", field.alias("field"))
    return rows.select("id", F.round(P.blob_score(F.col("field"), SHAPE, (75.0, 85.0, 92.0), (2, 6)), 5).alias("score"))


@query("legacy_ablation")
def legacy_ablation(spark, sf_dir):
    """The older cascade over each label's sequence of grids, with each stage left out in turn, as counts; a span
    of 512 frames is a key. tests/test_pipelines.py holds it against a loop."""
    rows = _grids(spark, sf_dir).withColumn("hour", F.col("id") % 24).withColumn("span", F.concat_ws("/", "label", F.floor(F.col("id") / 512)))
    config = legacy.LegacyConfig(z=1.8, night=118.0, indirect=121.0, spot_tiles=3, spot_dark=60.0, spot_noise=60.0, fresh_dark=30.0, drift_tiles=2, quiet=0.02)
    found = legacy.legacy_cascade(rows, "span", ["id"], config, ("", *legacy.STAGES))
    return found.groupBy("without", "trigger", "label").agg(F.count("*").alias("frames"))


#: As many configurations as the published sweep has, in the fixture's units: with two resolutions 5184.
SWEPT = {
    "indirect": [0.0, 122.0, 124.0, 126.0], "z": [1.2, 1.5, 1.8], "quiet": [0.02, 0.05, 0.10], "dark": [20.0, 25.0, 30.0, 35.0], "fresh_dark": [10.0, 15.0, 20.0],
    "spot_tiles": [0, 5], "spot_still": [5.0, 8.0, 10.0],
}
_SWEPT_FROM = legacy.LegacyConfig(night=120.0, spot_dark=60.0, spot_noise=60.0, drift_tiles=2)
#: The variants of what is called quiet: all odd cells or dark ones, over all cells or steady ones.
VARIANTS = {"dark_only": [False, True], "steady": ["", "abs", "rel"], "steady_limit": [20.0, 28.0, 0.2, 0.3], "quiet": [0.02, 0.05, 0.10]}


def swept_frames(spark, sf_dir):
    """Grids of a label as a sequence, at full and at a quarter of the cells; frames with a very dark cell are to be kept."""
    rows = _grids(spark, sf_dir).select("id", "label", (F.col("id") % 24).alias("hour"), "tile", (F.array_min("tile") < 60).alias("process"))
    four = lambda i: (F.get("tile", i) + F.get("tile", i + 1) + F.get("tile", i + 8) + F.get("tile", i + 9)) / 4
    coarse = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: four((F.floor(k / 4) * 16 + k % 4 * 2).cast("int")))
    both = rows.withColumn("cells", F.lit(64)).union(rows.withColumn("tile", coarse).withColumn("cells", F.lit(16)))
    return both.withColumn("sequence", F.concat_ws("/", "cells", "label"))


@query("cascade_sweep")
def cascade_sweep(spark, sf_dir):
    """5184 configurations of the whole older cascade, each with its own backgrounds: what they keep and lose.
    tests/test_pipelines.py holds a sample of them against runs one by one."""
    configs, frames_ = legacy.configurations(_SWEPT_FROM, SWEPT), swept_frames(spark, sf_dir)
    parts = [legacy.cascade_sweep(frames_.where(F.col("cells") == n), "sequence", ["id"], configs).withColumn("cells", F.lit(n)) for n in (64, 16)]
    recall = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    return parts[0].union(parts[1]).select("cells", "config", "tp", "fn", "fp", "tn", recall("tp", "fn").alias("process_recall"), recall("tn", "fp").alias("clouds_recall"))


@query("cascade_variants")
def cascade_variants(spark, sf_dir):
    """The cascade's two variants of QUIET, by dark cells and by steady ones, with the stages that they reach."""
    configs = legacy.configurations(_SWEPT_FROM, VARIANTS)
    found = legacy.cascade_sweep(swept_frames(spark, sf_dir).where("cells = 64"), "sequence", ["id"], configs)
    return found.select("config", "tp", "fn", "fp", "tn", *[F.col("stages")[k].alias(name.lower()) for k, name in enumerate((*legacy.STAGES, "AMBIGUOUS"))])
