"""Queries of the live path: sequence features, bands, score table and the suppression decision."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import solar
from tidemark.operators import sequence, suppression as S
from tidemark.registry import query
from tidemark.sources.frames import FRAMES, frames

#: On the fixture a device's events are far apart, so bursts there take an hour instead of a minute.
WITHIN = 3600.0


def _series(coefficients, angle: str) -> str:
    waves = [f"{c!r} * {'cos' if i % 2 == 0 else 'sin'}({angle} * {i // 2 + 1})" for i, c in enumerate(coefficients[1:])]
    return "(" + " + ".join([repr(coefficients[0]), *waves]) + ")"


_LAT = math.radians(solar.LATITUDE)
_HOUR = "(hour(captured_at) + minute(captured_at) / 60.0 + floor(second(captured_at)) / 3600.0)"
_G = f"({2 * math.pi / 365!r} * (dayofyear(captured_at) - 1 + ({_HOUR} - 12) / 24))"
_DECL = _series(solar.DECLINATION, _G)
_ANGLE = f"radians(({_HOUR} * 60 + 229.18 * {_series(solar.EQUATION, _G)} + 4 * {solar.LONGITUDE}) / 4 - 180)"
_COS = f"greatest(-1.0, least(1.0, {math.sin(_LAT)!r} * sin({_DECL}) + {math.cos(_LAT)!r} * cos({_DECL}) * cos({_ANGLE})))"
ELEVATION = f"(90 - degrees(acos({_COS})))"
_AZ = f"degrees(acos(greatest(-1.0, least(1.0, -({math.sin(_LAT)!r} * {_COS} - sin({_DECL})) / ({math.cos(_LAT)!r} * sin(acos({_COS})))))))"


def _sun(day: str, sunset: bool) -> str:
    b = f"({2 * math.pi!r} * ({day} - 1) / 365)"
    decl = _series(solar.DECLINATION, b)
    cosine = f"(({math.cos(math.radians(solar.ZENITH_RISE))!r} - {math.sin(_LAT)!r} * sin({decl})) / ({math.cos(_LAT)!r} * cos({decl})))"
    noon = f"(720 - 4 * {solar.LONGITUDE} - 229.18 * {_series(solar.EQUATION_RISE, b)})"
    return f"CAST(trunc({noon} {'+' if sunset else '-'} 4 * degrees(acos({cosine}))) AS INTEGER)"


def _band(value: str, edges) -> str:
    return "(" + " + ".join(f"CAST({value} >= {e} AS INTEGER)" for e in edges) + ")"


def _motion(within: float) -> str:
    return f"""{FRAMES},
g AS (SELECT *, coalesce((us - lag(us) OVER w) / 1e6, 1e6) AS quiet_gap FROM frames WHERE source = 'pir' WINDOW w AS (PARTITION BY device ORDER BY us, id)),
i AS (SELECT *, sum(CAST(quiet_gap >= {within} AS INTEGER)) OVER (PARTITION BY device ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM g),
m AS (SELECT *, CAST(least(row_number() OVER (PARTITION BY device, island ORDER BY us, id) - 1, 250) AS INTEGER) AS burst_pos, {ELEVATION} AS elevation FROM i),
c AS (SELECT *, ({_band("elevation", S.ELEVATION_EDGES)} * 6 + {_band("quiet_gap", S.GAP_EDGES)}) * 4 + least(burst_pos, 3) AS cell FROM m)"""


_TABLE = f"t AS (SELECT unnest(range(192)) AS cell, unnest([{', '.join(map(str, S.SCORES))}]) AS score)"


@query(
    "suppression_decision",
    f"""WITH {_motion(WITHIN)}, {_TABLE}
SELECT id, device, round(quiet_gap, 3) AS quiet_gap, burst_pos, round(elevation, 3) AS elevation, CAST(c.cell AS INTEGER) AS cell, coalesce(score, 255) AS score,
  CASE WHEN coalesce(score, 255) < 40 THEN 'SCORE' ELSE 'PROCEED' END AS why, coalesce(score, 255) < 40 AS suppress FROM c LEFT JOIN t USING (cell)
UNION ALL SELECT id, device, -1.0, 0, round({ELEVATION}, 3), NULL, 255, 'RTC', false FROM frames WHERE source IS DISTINCT FROM 'pir'""",
)
def suppression_decision(spark, sf_dir):
    """D08 over W01, W02, P12 and J05: the flagship."""
    out = S.decide(frames(spark, sf_dir), within=WITHIN)
    return out.select("id", "device", F.round("quiet_gap", 3).alias("quiet_gap"), "burst_pos", F.round("elevation", 3).alias("elevation"), "cell", "score", "why", "suppress")


@query("quiet_gaps", f"WITH {FRAMES} SELECT id, coalesce((us - lag(us) OVER (PARTITION BY device ORDER BY us, id)) / 1e6, 1e6) AS quiet_gap FROM frames WHERE source = 'pir'")
def quiet_gaps(spark, sf_dir):
    """W01."""
    return frames(spark, sf_dir).where("source = 'pir'").select("id", sequence.quiet_gap().alias("quiet_gap"))


@query("burst_positions", f"WITH {_motion(WITHIN)} SELECT burst_pos, count(*) AS events, count(DISTINCT device) AS devices FROM c GROUP BY burst_pos")
def burst_positions(spark, sf_dir):
    """W02."""
    motion = sequence.with_burst_position(frames(spark, sf_dir).where("source = 'pir'"), WITHIN)
    return motion.groupBy("burst_pos").agg(F.count("*").alias("events"), F.countDistinct("device").alias("devices"))


@query("solar_positions", f"WITH {FRAMES} SELECT id, round({ELEVATION}, 3) AS elevation, round(CASE WHEN abs(sin(acos({_COS}))) < 1e-6 THEN 180.0 WHEN {_ANGLE} > 0 THEN 360 - {_AZ} ELSE {_AZ} END, 3) AS azimuth FROM frames")
def solar_positions(spark, sf_dir):
    at = F.col("captured_at")
    return frames(spark, sf_dir).select("id", F.round(solar.elevation(at), 3).alias("elevation"), F.round(solar.azimuth(at), 3).alias("azimuth"))


@query("sun_times", f"SELECT d AS day, {_sun('d', False)} AS sunrise, {_sun('d', True)} AS sunset FROM (SELECT unnest(range(1, 366)) AS d)")
def sun_times(spark, sf_dir):
    day = F.col("id")
    return spark.range(1, 366).select(day.alias("day"), solar.sun_minutes(day, False).alias("sunrise"), solar.sun_minutes(day, True).alias("sunset"))


@query(
    "next_wakes",
    f"""WITH {FRAMES}, d AS (SELECT id, us // 1000000 + 7200 AS due FROM frames),
e AS (SELECT *, due // 86400 * 86400 AS midnight, (due % 86400) // 60 AS minute FROM d),
f AS (SELECT *, {_sun("dayofyear(make_timestamp(due * 1000000))", False)} AS rise, {_sun("dayofyear(make_timestamp(due * 1000000))", True)} AS sunset, {_sun("dayofyear(make_timestamp((midnight + 86400) * 1000000))", False)} AS tomorrow FROM e)
SELECT id, CASE WHEN minute >= rise AND minute < sunset + 30 THEN due WHEN minute >= sunset + 30 THEN midnight + 86400 + tomorrow * 60 ELSE midnight + rise * 60 END AS wake FROM f""",
)
def next_wakes(spark, sf_dir):
    return frames(spark, sf_dir).select("id", solar.next_wake(F.floor(F.col("us") / 1000000), 120).cast("long").alias("wake"))


@query(
    "wake_schedule",
    f"""WITH d AS (SELECT unnest(range(1, 366)) AS d), s AS (SELECT d, 1704067200 + (d - 1) * 86400 AS day, greatest({_sun("d", False)}, 0) * 60 AS rise, least({_sun("d", True)}, 1440) * 60 + 1800 AS last FROM d),
w AS (SELECT d, unnest(range(CAST(day + rise AS BIGINT), CAST(day + least(last, 86400) AS BIGINT), 7200)) AS wake FROM s) SELECT d AS day, count(*) AS wakes, min(wake) AS first, max(wake) AS last FROM w GROUP BY d""",
)
def wake_schedule(spark, sf_dir):
    """The timer's wakes of a year, two hours apart from sunrise until half an hour after sunset."""
    days = spark.range(1, 366).select(F.col("id").alias("day"), (F.lit(1704067200) + (F.col("id") - 1) * 86400).alias("midnight"))
    return solar.schedule(days, "midnight", 120).groupBy("day").agg(F.count("*").alias("wakes"), F.min("wake").alias("first"), F.max("wake").alias("last"))


@query("score_cells", f"WITH {_motion(WITHIN)}, {_TABLE} SELECT t.cell, score, count(c.id) AS events FROM t LEFT JOIN c ON c.cell = t.cell GROUP BY t.cell, score")
def score_cells(spark, sf_dir):
    """The dense table, with the events in each cell."""
    events = S.decide(frames(spark, sf_dir), within=WITHIN).where("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))
    return S.score_table(spark).join(events, "cell", "left").select("cell", "score", F.coalesce("n", F.lit(0)).alias("events"))


@query(
    "smoothed_cell_rates",
    f"""WITH {_motion(WITHIN)}, b AS (SELECT avg(CAST(coalesce(label, '') = 'bird' AS INTEGER)) AS base FROM c),
k AS (SELECT cell, count(*) AS n, sum(CAST(coalesce(label, '') = 'bird' AS INTEGER)) AS k FROM c GROUP BY cell)
SELECT CAST(s.cell AS INTEGER) AS cell, round((coalesce(k, 0) + 4 * base) / (coalesce(n, 0) + 4), 6) AS rate FROM (SELECT unnest(range(192)) AS cell) s LEFT JOIN k ON k.cell = s.cell CROSS JOIN b""",
)
def smoothed_cell_rates(spark, sf_dir):
    """A rate for all cells, drawn to the overall one by four events' weight."""
    events = S.decide(frames(spark, sf_dir), within=WITHIN).where("cell is not null").select("cell", F.coalesce(F.col("label") == "bird", F.lit(False)).cast("int").alias("hit"))
    base = events.agg(F.avg("hit").alias("base"))
    cells = events.groupBy("cell").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    spine = spark.range(192).select(F.col("id").cast("int").alias("cell"))
    return spine.join(cells, "cell", "left").crossJoin(base).select("cell", F.round((F.coalesce("k", F.lit(0)) + 4 * F.col("base")) / (F.coalesce("n", F.lit(0)) + 4), 6).alias("rate"))


@query("rates_by_gap_and_burst", f"WITH {_motion(WITHIN)} SELECT {_band('quiet_gap', S.GAP_EDGES)} AS gap_band, least(burst_pos, 3) AS burst, count(*) AS events, round(avg(CAST(coalesce(label, '') = 'bird' AS INTEGER)), 6) AS rate FROM c GROUP BY 1, 2")
def rates_by_gap_and_burst(spark, sf_dir):
    """A13."""
    events = S.decide(frames(spark, sf_dir), within=WITHIN).where("cell is not null")
    hit = F.coalesce(F.col("label") == "bird", F.lit(False)).cast("int")
    return events.groupBy(S.band(F.col("quiet_gap"), S.GAP_EDGES).alias("gap_band"), F.least("burst_pos", F.lit(3)).alias("burst")).agg(F.count("*").alias("events"), F.round(F.avg(hit), 6).alias("rate"))


@query(
    "cell_centroids",
    """WITH e AS (SELECT unnest(range(8)) AS a, unnest([-5.0, 2.5, 7.5, 15.0, 25.0, 35.0, 45.0, 57.5]) AS elevation), g AS (SELECT unnest(range(6)) AS b, unnest([7.5, 37.5, 180.0, 1050.0, 4500.0, 10800.0]) AS gap), p AS (SELECT unnest(range(4)) AS c)
SELECT CAST((a * 6 + b) * 4 + c AS INTEGER) AS cell, CAST(elevation AS DOUBLE) AS elevation, CAST(gap AS DOUBLE) AS gap, CAST(c AS INTEGER) AS burst FROM e, g, p""",
)
def cell_centroids(spark, sf_dir):
    """M02's grid: the middle of each cell."""
    return centroids(spark)


def centroids(spark):
    middles = lambda edges, low, high: [(a + b) / 2 for a, b in zip((low, *edges), (*edges, high), strict=True)]
    rows = [(e, g, b) for e in middles(S.ELEVATION_EDGES, -10.0, 65.0) for g in middles(S.GAP_EDGES, 0.0, 14400.0) for b in range(S.N_BURST)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cell int, elevation double, gap double, burst int")


@query(
    "cycle_routing",
    f"""WITH {_motion(WITHIN)}, {_TABLE}, d AS (SELECT id, source, result, coalesce(score, 255) < 40 AS suppress FROM c LEFT JOIN t USING (cell) UNION ALL SELECT id, source, result, false FROM frames WHERE source IS DISTINCT FROM 'pir')
SELECT id, CASE WHEN suppress AND id % 10 <> 0 THEN 'spool' WHEN source = 'pir' AND result = 'clouds' THEN 'spool_clouds' ELSE 'upload' END AS route FROM d""",
)
def cycle_routing(spark, sf_dir):
    """Suppressed events are spooled if the store is mounted (here: unless the id ends in 0); motion frames that the
    burst filter calls clouds are spooled too; all else is uploaded."""
    out = S.decide(frames(spark, sf_dir), within=WITHIN)
    mounted = F.col("id") % 10 != 0
    clouds = (F.col("source") == "pir") & (F.col("result") == "clouds")
    return out.select("id", F.when(F.col("suppress") & mounted, "spool").when(clouds, "spool_clouds").otherwise("upload").alias("route"))


@query(
    "temporal_rule",
    f"WITH {_motion(WITHIN)} SELECT id, quiet_gap < 900 OR burst_pos >= 2 OR gm > 72 AS suppress FROM c",
)
def temporal_rule(spark, sf_dir):
    """Gap, burst and residual thresholds joined by or."""
    motion = sequence.with_burst_position(frames(spark, sf_dir).where("source = 'pir'"), WITHIN)
    return motion.select("id", ((F.col("quiet_gap") < 900) | (F.col("burst_pos") >= 2) | (F.col("gm") > 72)).alias("suppress"))


@query("since_previous", f"WITH {FRAMES}, g AS (SELECT id, (us - lag(us) OVER (PARTITION BY device ORDER BY us, id)) / 1e6 AS dt FROM frames) SELECT id, CASE WHEN dt IS NULL OR dt < 0 THEN 'inf' ELSE CAST(CAST(floor(dt) AS BIGINT) AS VARCHAR) END AS replay, CASE WHEN dt IS NULL THEN 'inf' ELSE CAST(CAST(floor(greatest(dt, 0)) AS BIGINT) AS VARCHAR) END AS live FROM g")
def since_previous(spark, sf_dir):
    """W03, both variants of a clock that went back: infinite in replay, 0 in the live path."""
    text = lambda c: F.when(c == float("inf"), "inf").otherwise(F.floor(c).cast("string"))
    return frames(spark, sf_dir).select("id", text(sequence.elapsed(None)).alias("replay"), text(sequence.elapsed(0.0)).alias("live"))


@query(
    "transitions",
    f"""WITH {FRAMES}, g AS (SELECT id, device, us, result, result IS NULL AS broken, lag(result) OVER w AS before, lag(us) OVER w AS before_us FROM frames WINDOW w AS (PARTITION BY device ORDER BY us, id))
SELECT before || '→' || result AS transition, count(*) AS pairs, round(avg((us - before_us) / 6e7), 3) AS gap_minutes FROM g WHERE result IS NOT NULL AND before IS NOT NULL GROUP BY 1""",
)
def transitions(spark, sf_dir):
    """Consecutive pairs; a frame without a result breaks the chain."""
    w = Window.partitionBy("device").orderBy("us", "id")
    pairs = frames(spark, sf_dir).select("result", "us", F.lag("result").over(w).alias("before"), F.lag("us").over(w).alias("before_us")).where("result is not null and before is not null")
    return pairs.groupBy(F.concat_ws("→", "before", "result").alias("transition")).agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("us") - F.col("before_us")) / 6e7), 3).alias("gap_minutes"))
