"""Queries of model fitting; tests/test_fitting.py holds those without a SQL twin against small loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fitting, grid, suppression
from tidemark.plans.grids import _grids
from tidemark.plans.suppression import WITHIN, centroids
from tidemark.registry import query
from tidemark.sources.frames import FRAMES, frames, table


@query("brightness_clusters")
def brightness_clusters(spark, sf_dir):
    """A23."""
    return fitting.clustered(table(spark, sf_dir, "embeddings"), "embedding").groupBy("cluster").agg(F.count("*").alias("vectors"))


@query("tile_spreads")
def tile_spreads(spark, sf_dir):
    """A23's spread of each cell within the clusters."""
    found = fitting.tile_spread(fitting.clustered(table(spark, sf_dir, "embeddings"), "embedding"), "embedding")
    return found.select(F.col("tile").cast("long").alias("tile"), F.round("spread", 6).alias("spread"))


@query("principal_components")
def principal_components(spark, sf_dir):
    """A24."""
    return fitting.projected(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", F.transform("components", lambda x: F.round(F.abs(x), 6)).alias("magnitudes"))


#: The published rounds and rate.
BOOST = fitting.BoostConfig()


def _events(spark, sf_dir):
    rows = suppression.decide(frames(spark, sf_dir), within=WITHIN).where("cell is not null")
    hit = F.coalesce(F.col("label") == "bird", F.lit(False)).cast("double")
    return rows.select("id", F.floor(F.col("us") / 86400000000).alias("day"), "elevation", F.least("quiet_gap", F.lit(14400.0)).alias("gap"), F.col("burst_pos").cast("double").alias("burst"), hit.alias("hit"))


@query("out_of_fold_scores")
def out_of_fold_scores(spark, sf_dir):
    """Boosted trees, folds by day."""
    return fitting.out_of_fold(_events(spark, sf_dir), ["elevation", "gap", "burst"], "hit", "day", c=BOOST).select("id", "fold", "score", "hit")


@query("distilled_table")
def distilled_table(spark, sf_dir):
    """The model's score at the middle of each cell, quantised to 0 to 255 by dense rank."""
    from tidemark.operators.evaluation import quantised

    scored = fitting.boosted(_events(spark, sf_dir), ["elevation", "gap", "burst"], "hit", BOOST)(centroids(spark).withColumn("burst", F.col("burst").cast("double")))
    rank, q = quantised(F.round("score", 9))
    return scored.withColumn("__rank", rank).select("cell", q.alias("score"))


@query("table_gate")
def table_gate(spark, sf_dir):
    """Whether the table suppresses at least 0.85 of what the model does, without losing a positive."""
    from tidemark.operators.evaluation import suppression_curve

    events = _events(spark, sf_dir)
    score = fitting.boosted(events, ["elevation", "gap", "burst"], "hit", BOOST)
    model = suppression_curve(score(events).select(F.round("score", 9).alias("s"), "hit"), "s", "hit")
    cells = score(centroids(spark).withColumn("burst", F.col("burst").cast("double"))).select("cell", F.round("score", 9).alias("s"))
    own = events.withColumn("cell", suppression.cell(F.col("elevation"), F.col("gap"), F.col("burst").cast("int"))).join(F.broadcast(cells), "cell")
    tabled = suppression_curve(own.select("s", "hit"), "s", "hit")
    best = lambda c, name: c.where("lost = 0").agg(F.coalesce(F.max("fraction"), F.lit(0.0)).alias(name))
    return best(tabled, "table_zero_loss").crossJoin(best(model, "model_zero_loss")).withColumn("ships", F.col("table_zero_loss") >= 0.85 * F.col("model_zero_loss"))


@query("camera_shifts")
def camera_shifts(spark, sf_dir):
    """Each grid against the next one of its label."""
    from pyspark.sql import Window

    pairs = _grids(spark, sf_dir).select("id", F.col("tile").alias("a"), F.lead("tile").over(Window.partitionBy("label").orderBy("id")).alias("b")).where("b is not null")
    return fitting.shifts(pairs, 8, 8).select("id", *[F.round(c, 4).alias(c) for c in ("dy", "dx", "confidence")])


@query("regime_bank")
def regime_bank(spark, sf_dir):
    """W13, DM6."""
    rows = _grids(spark, sf_dir).select("id", "label", grid.descriptor(F.col("tile")).alias("d"))
    return fitting.regime_bank(rows, "label", ["id"], "d", near=0.02)


@query(
    "scene_breaks",
    f"""WITH RECURSIVE {FRAMES}, n AS (SELECT device, id, CAST(gm AS DOUBLE) AS x, row_number() OVER (PARTITION BY device ORDER BY us, id) AS i FROM frames WHERE result = 'clouds'),
r AS (SELECT device, i, id, x AS m, 7 AS quick, CAST(0 AS DOUBLE) AS residual, true AS broke FROM n WHERE i = 1
UNION ALL SELECT n.device, n.i, n.id, CASE WHEN abs(x - m) > 30 THEN x WHEN quick > 0 THEN m + 0.5 * (x - m) ELSE m + 0.15 * (x - m) END, CASE WHEN abs(x - m) > 30 THEN 7 ELSE greatest(quick - 1, 0) END, abs(x - m), abs(x - m) > 30 FROM r JOIN n ON n.device = r.device AND n.i = r.i + 1)
SELECT id, round(residual, 6) AS residual, broke FROM r""",
)
def scene_breaks(spark, sf_dir):
    """W11."""
    rows = frames(spark, sf_dir).where("result = 'clouds'").select("id", "device", "us", "gm")
    return fitting.scene_breaks(rows, "device", ["us", "id"], "gm").select("id", F.round("residual", 6).alias("residual"), "broke")
