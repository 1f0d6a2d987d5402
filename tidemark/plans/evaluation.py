"""Queries of calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import selection
from tidemark.registry import query
from tidemark.sources.frames import FRAMES, frames, table

#: A stand-in for a detector's result: dark frames and low readings are called clouds.
_PREDICTED = "CASE WHEN gm < 100 THEN 'clouds' ELSE 'process' END"
_TRUTH = "CASE WHEN result = 'clouds' THEN 'clouds' ELSE 'process' END"
_CONFUSION = """count(*) FILTER (t <> 'clouds' AND p <> 'clouds') AS tp, count(*) FILTER (t <> 'clouds' AND p = 'clouds') AS fn, count(*) FILTER (t = 'clouds' AND p = 'clouds') AS tn, count(*) FILTER (t = 'clouds' AND p <> 'clouds') AS fp,
round(avg(CAST(t = p AS INTEGER)), 6) AS accuracy, round(coalesce(avg(CAST(p <> 'clouds' AS INTEGER)) FILTER (t <> 'clouds'), 0), 6) AS process_recall, round(coalesce(avg(CAST(p = 'clouds' AS INTEGER)) FILTER (t = 'clouds'), 0), 6) AS clouds_recall"""


def _judged(spark, sf_dir):
    predicted = F.when(F.col("gm") < 100, "clouds").otherwise("process")
    truth = F.when(F.col("result") == "clouds", "clouds").otherwise("process")
    return frames(spark, sf_dir).select("*", predicted.alias("p"), truth.alias("t"))


@query("confusion_matrix", f"WITH {FRAMES}, j AS (SELECT *, {_PREDICTED} AS p, {_TRUTH} AS t FROM frames) SELECT {_CONFUSION} FROM j")
def confusion_matrix(spark, sf_dir):
    """A06."""
    return _judged(spark, sf_dir).agg(*E.confusion(F.col("t"), F.col("p"), "clouds"))


@query("accuracy_by_domain", f"WITH {FRAMES}, j AS (SELECT *, {_PREDICTED} AS p, {_TRUTH} AS t FROM frames) SELECT coalesce(label, 'none') AS domain, {_CONFUSION} FROM j GROUP BY 1")
def accuracy_by_domain(spark, sf_dir):
    """A07."""
    return _judged(spark, sf_dir).groupBy(F.coalesce("label", F.lit("none")).alias("domain")).agg(*E.confusion(F.col("t"), F.col("p"), "clouds"))


@query("trigger_histogram", f"WITH {FRAMES} SELECT coalesce(result, 'none') AS trigger, count(*) AS frames FROM frames GROUP BY 1")
def trigger_histogram(spark, sf_dir):
    """A08."""
    return frames(spark, sf_dir).groupBy(F.coalesce("result", F.lit("none")).alias("trigger")).agg(F.count("*").alias("frames"))


@query("recall_summary", f"WITH {FRAMES}, d AS (SELECT *, {_PREDICTED} AS p FROM frames WHERE gm >= 20) SELECT count(*) FILTER (label = 'bird') AS birds, count(*) FILTER (label = 'bird' AND p = 'process') AS caught, count(*) FILTER (source = 'rtc' AND p = 'process') AS rtc_false, count(*) FILTER (source = 'pir' AND p = 'clouds') AS pir_suppressed, list(id ORDER BY id) FILTER (label = 'bird' AND p = 'clouds') AS missed FROM d")
def recall_summary(spark, sf_dir):
    """A10, without night frames; the missed birds' ids, of labelled frames alone."""
    d = _judged(spark, sf_dir).where("gm >= 20")
    bird, keep = F.col("label") == "bird", F.col("p") == "process"
    return d.agg(F.count_if(bird).alias("birds"), F.count_if(bird & keep).alias("caught"), F.count_if((F.col("source") == "rtc") & keep).alias("rtc_false"), F.count_if((F.col("source") == "pir") & ~keep).alias("pir_suppressed"), F.sort_array(F.collect_list(F.when(bird & ~keep, F.col("id")))).alias("missed"))


@query("blob_summary", f"WITH {FRAMES} SELECT round(avg(gm % 7), 6) AS mean_blobs, count(*) FILTER (gm % 7 = 0) AS without, bool_or(label = 'bird' AND gm % 7 > 0) AS bird_hit FROM frames WHERE source = 'rtc'")
def blob_summary(spark, sf_dir):
    """A11, A31."""
    blobs = F.col("gm") % 7
    return frames(spark, sf_dir).where("source = 'rtc'").agg(F.round(F.avg(blobs), 6).alias("mean_blobs"), F.count_if(blobs == 0).alias("without"), F.bool_or((F.col("label") == "bird") & (blobs > 0)).alias("bird_hit"))


_SCORED = f"{FRAMES}, s AS (SELECT id, gm AS score, coalesce(label, '') = 'bird' AS hit FROM frames)"
_CURVE = f"""{_SCORED}, b AS (SELECT score AS cut, count(*) AS n, sum(CAST(hit AS INTEGER)) AS k FROM s GROUP BY 1),
c AS (SELECT cut, coalesce(sum(n) OVER w, 0) / sum(n) OVER () AS fraction, coalesce(sum(k) OVER w, 0) AS lost FROM b WINDOW w AS (ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) UNION ALL SELECT NULL, 1.0, (SELECT sum(k) FROM b))"""


def _scored(spark, sf_dir):
    return frames(spark, sf_dir).select("id", F.col("gm").alias("score"), F.coalesce(F.col("label") == "bird", F.lit(False)).alias("hit"))


@query("suppression_curve", f"WITH {_CURVE} SELECT cut, round(fraction, 6) AS fraction, CAST(lost AS BIGINT) AS lost FROM c")
def suppression_curve(spark, sf_dir):
    """All cuts."""
    return E.suppression_curve(_scored(spark, sf_dir), "score", "hit").select("cut", F.round("fraction", 6).alias("fraction"), "lost")


@query("curve_targets", f"WITH {_CURVE}, f AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS target) SELECT CAST(target AS DOUBLE) AS target, CAST(coalesce(arg_max(lost, fraction), 0) AS BIGINT) AS lost, (SELECT round(max(fraction), 6) FROM c WHERE lost = 0) AS zero_loss FROM f LEFT JOIN c ON fraction <= target + 1e-12 GROUP BY target")
def curve_targets(spark, sf_dir):
    """A14, M03's figures: the positives lost at the largest share within each target, and the largest share without loss."""
    curve = E.suppression_curve(_scored(spark, sf_dir), "score", "hit")
    targets = spark.createDataFrame([(x / 10,) for x in range(1, 6)], "target double")
    zero = curve.where("lost = 0").agg(F.round(F.max("fraction"), 6).alias("zero_loss"))
    best = targets.join(F.broadcast(curve), F.col("fraction") <= F.col("target") + 1e-12, "left").groupBy("target").agg(F.coalesce(F.max_by("lost", "fraction"), F.lit(0)).alias("lost"))
    return best.crossJoin(zero)


@query("threshold_choice", f"WITH {_CURVE} SELECT cut, round(fraction, 6) AS fraction FROM c WHERE cut IS NOT NULL AND fraction > 0 ORDER BY abs(fraction - 0.35), cut LIMIT 1")
def threshold_choice(spark, sf_dir):
    """The cut whose share is nearest to the target, the lower one on ties, an empty share left out."""
    curve = E.suppression_curve(_scored(spark, sf_dir), "score", "hit").where("cut is not null and fraction > 0")
    return curve.orderBy(F.abs(F.col("fraction") - 0.35), "cut").limit(1).select("cut", F.round("fraction", 6).alias("fraction"))


@query("auc", f"WITH {_SCORED}, r AS (SELECT hit, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), c AS (SELECT count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS n, sum(r) FILTER (hit) AS w FROM r) SELECT round((w - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM c")
def auc(spark, sf_dir):
    """Rank sums instead of all pairs."""
    return E.auc(_scored(spark, sf_dir), "score", "hit").select(F.round("auc", 6).alias("auc"))


@query("percentiles", f"WITH {FRAMES} SELECT source, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM frames GROUP BY source")
def percentiles(spark, sf_dir):
    """With linear interpolation, by refined histograms."""
    cuts = selection.quantiles(frames(spark, sf_dir), ["source"], "value", [0.5, 0.9, 0.95, 0.99])
    return cuts.select("source", *[F.round(F.col("quantiles")[i], 6).alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))])


@query("recall_at_false_rate", f"WITH {FRAMES}, t AS (SELECT unnest([0.1, 0.01]) AS rate, unnest([quantile_cont(value, 0.9), quantile_cont(value, 0.99)]) AS threshold FROM frames WHERE source = 'rtc') SELECT CAST(rate AS DOUBLE) AS rate, round(threshold, 6) AS threshold, round(avg(CAST(value > threshold AS INTEGER)), 6) AS recall FROM t, frames WHERE label = 'bird' GROUP BY 1, 2")
def recall_at_false_rate(spark, sf_dir):
    """Two thresholds, so the cross join doubles the labelled rows."""
    f = frames(spark, sf_dir)
    cuts = selection.quantiles(f.where("source = 'rtc'"), [], "value", [0.9, 0.99]).select(F.col("quantiles").alias("cuts"))
    thresholds = cuts.select(F.explode(F.arrays_zip(F.array(F.lit(0.1), F.lit(0.01)).alias("rate"), F.col("cuts").alias("threshold"))).alias("x")).select("x.rate", "x.threshold")
    hits = f.where("label = 'bird'").select("value").crossJoin(F.broadcast(thresholds))
    return hits.groupBy("rate", F.round("threshold", 6).alias("threshold")).agg(F.round(F.avg((F.col("value") > F.col("threshold")).cast("int")), 6).alias("recall"))


@query(
    "sweep",
    f"WITH {FRAMES}, c AS (SELECT a * 20 AS low, b * 5 AS high FROM range(1, 9) x(a), range(1, 9) y(b)), r AS (SELECT low, high, count(*) FILTER (label = 'bird' AND (gm < low OR value > high)) / greatest(count(*) FILTER (label = 'bird'), 1) AS recall, count(*) FILTER (source = 'rtc' AND (gm < low OR value > high)) AS false_positives FROM frames, c WHERE label = 'bird' OR source = 'rtc' GROUP BY 1, 2) SELECT low, high, round(recall, 6) AS recall, false_positives, row_number() OVER (ORDER BY recall DESC, false_positives, low, high) = 1 AS chosen FROM r",
)
def sweep(spark, sf_dir):
    """All configurations over the rows that count; full recall with the fewest false positives, else most recall.
    64 configurations are sent to the rows; the pairs are summed up where they arise."""
    configs = spark.createDataFrame([(a * 20, b * 5) for a in range(1, 9) for b in range(1, 9)], "low long, high long")
    rows = frames(spark, sf_dir).where("label = 'bird' OR source = 'rtc'").select("gm", "value", (F.col("label") == "bird").alias("bird"), (F.col("source") == "rtc").alias("rtc"))
    fires = (F.col("gm") < F.col("low")) | (F.col("value") > F.col("high"))
    r = rows.crossJoin(F.broadcast(configs)).groupBy("low", "high").agg((F.count_if(F.col("bird") & fires) / F.greatest(F.count_if("bird"), F.lit(1))).alias("recall"), F.count_if(F.col("rtc") & fires).alias("false_positives"))
    place = F.row_number().over(Window.orderBy(F.desc("recall"), "false_positives", "low", "high"))
    return r.select("low", "high", F.round("recall", 6).alias("recall"), "false_positives", (place == 1).alias("chosen"))


#: Limits of the four-way sweep: 6 x 6 x 12 x 12 configurations.
_GRID = {"low": [20 * k for k in range(1, 7)], "high": [15 * k for k in range(1, 7)], "bright": [12 * k + 100 for k in range(12)], "step": [8 * k for k in range(12)]}
_FIRES = "gm < low OR value > high OR (gm > bright AND k >= step)"


@query(
    "wide_sweep",
    f"""WITH {FRAMES}, c AS (SELECT * FROM {" CROSS JOIN ".join(f"(SELECT unnest({v}) AS {n})" for n, v in _GRID.items())}),
e AS (SELECT gm, k, least(ceil(value / 15), 7) AS band, count(*) FILTER (label = 'bird') AS birds, count(*) FILTER (source = 'rtc') AS rtc FROM frames WHERE label = 'bird' OR source = 'rtc' GROUP BY 1, 2, 3),
r AS (SELECT low, high, bright, step, CAST(sum(CASE WHEN {_FIRES.replace("value > high", "band > high / 15")} THEN birds ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN {_FIRES.replace("value > high", "band > high / 15")} THEN rtc ELSE 0 END) AS BIGINT) AS false_positives, sum(birds) AS birds FROM e, c GROUP BY ALL)
SELECT CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, CAST(bright AS BIGINT) AS bright, CAST(step AS BIGINT) AS step, round(hits / greatest(birds, 1), 6) AS recall, false_positives FROM r""",
)
def wide_sweep(spark, sf_dir):
    """A26 at its size: 5184 configurations. Rows are first summed up by what the configurations can tell apart, which is
    bounded by their limits and not by the rows."""
    configs = spark.range(1).select(F.lit(0).alias("x"))
    for name, values in _GRID.items():
        configs = configs.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    rows = frames(spark, sf_dir).where("label = 'bird' OR source = 'rtc'")
    band = F.least(F.ceil(F.col("value") / 15), F.lit(7))
    cells = rows.groupBy("gm", "k", band.alias("band")).agg(F.count_if(F.col("label") == "bird").alias("birds"), F.count_if(F.col("source") == "rtc").alias("rtc"))
    fires = F.expr("gm < low OR band > high / 15 OR (gm > bright AND k >= step)")
    sums = cells.crossJoin(F.broadcast(configs.drop("x"))).groupBy(*_GRID).agg(F.sum(F.when(fires, F.col("birds")).otherwise(0)).alias("hits"), F.sum(F.when(fires, F.col("rtc")).otherwise(0)).alias("false_positives"), F.sum("birds").alias("birds"))
    return sums.select(*[F.col(c).cast("long").alias(c) for c in _GRID], F.round(F.col("hits") / F.greatest("birds", F.lit(1)), 6).alias("recall"), "false_positives")


@query("zero_loss_regions", f"WITH {FRAMES}, c AS (SELECT a * 10 + 20 AS low, b AS rest FROM range(1, 15) x(a), range(0, 20) y(b)), r AS (SELECT low, rest, avg(CAST(gm < low AND k >= 80 + rest AS INTEGER)) AS share, count(*) FILTER (label = 'bird' AND gm < low AND k >= 80 + rest) AS birds FROM frames, c GROUP BY 1, 2) SELECT low, rest, round(share, 6) AS share FROM r WHERE birds = 0 ORDER BY share DESC, low, rest LIMIT 10")
def zero_loss_regions(spark, sf_dir):
    """280 regions; rows are first grouped by what the regions test."""
    configs = spark.createDataFrame([(a * 10 + 20, b) for a in range(1, 15) for b in range(20)], "low long, rest long")
    by = frames(spark, sf_dir).groupBy("gm", F.col("k").alias("r")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "bird").alias("birds"))
    inside = (F.col("gm") < F.col("low")) & (F.col("r") >= 80 + F.col("rest"))
    sums = by.crossJoin(F.broadcast(configs)).groupBy("low", "rest").agg((F.sum(F.when(inside, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.sum(F.when(inside, F.col("birds")).otherwise(0)).alias("b"))
    return sums.where("b = 0").orderBy(F.desc("share"), "low", "rest").limit(10).select("low", "rest", F.round("share", 6).alias("share"))


@query("separability", f"WITH {FRAMES}, b AS (SELECT min(value) AS low, max(value) AS high FROM frames WHERE label = 'bird') SELECT low, high, round(avg(CAST(value < low OR value > high AS INTEGER)), 6) AS beyond FROM frames, b WHERE source = 'pir' GROUP BY 1, 2")
def separability(spark, sf_dir):
    """A28."""
    f = frames(spark, sf_dir)
    ends = f.where("label = 'bird'").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return f.where("source = 'pir'").crossJoin(F.broadcast(ends)).groupBy("low", "high").agg(F.round(F.avg(((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).cast("int")), 6).alias("beyond"))


@query("battery_average", f"WITH {FRAMES}, r AS (SELECT id, (gm * 16 + k) // 16 AS raw FROM frames) SELECT id, raw, (raw * 320) // 220 AS millivolts FROM r")
def battery_average(spark, sf_dir):
    """Integer division throughout."""
    return frames(spark, sf_dir).select("id", F.expr("(gm * 16 + k) div 16").alias("raw")).select("id", "raw", F.expr("(raw * 320) div 220").alias("millivolts"))


@query("result_changes", f"WITH {FRAMES}, c AS (SELECT coalesce(label, 'none') AS label, coalesce(result, 'process') AS old, {_PREDICTED} AS new FROM frames) SELECT label, count(*) AS frames, count(*) FILTER (old <> new) AS changed, count(*) FILTER (old = 'process' AND new = 'clouds') AS lost, round(100.0 * count(*) FILTER (old <> new) / count(*), 4) AS percent FROM c GROUP BY label")
def result_changes(spark, sf_dir):
    """A32."""
    c = _judged(spark, sf_dir).select(F.coalesce("label", F.lit("none")).alias("label"), F.coalesce("result", F.lit("process")).alias("old"), F.col("p").alias("new"))
    changed = F.col("old") != F.col("new")
    return c.groupBy("label").agg(F.count("*").alias("frames"), F.count_if(changed).alias("changed"), F.count_if((F.col("old") == "process") & (F.col("new") == "clouds")).alias("lost"), F.round(100.0 * F.count_if(changed) / F.count("*"), 4).alias("percent"))


@query("quantised_scores", f"WITH {FRAMES}, s AS (SELECT k, round(avg(value), 2) AS score FROM frames GROUP BY k), d AS (SELECT k, dense_rank() OVER (ORDER BY score) - 1 AS r FROM s) SELECT k, CAST(round_even(r * 255 / greatest((SELECT max(r) FROM d), 1), 0) AS INTEGER) AS q FROM d")
def quantised_scores(spark, sf_dir):
    """Over a table of scores, as many as there are cells."""
    scores = frames(spark, sf_dir).groupBy("k").agg(F.round(F.avg("value"), 2).alias("score"))
    rank, scaled = E.quantised(F.col("score"))
    return scores.withColumn("__rank", rank).select("k", scaled.alias("q"))


@query(
    "group_median_error",
    "WITH m AS (SELECT source, median(n_chars) AS m, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY source), g AS (SELECT median(n_chars) AS g FROM documents WHERE doc_id % 5 <> 0) SELECT lang, round(avg(abs(n_chars - coalesce(CASE WHEN n >= 3 THEN m END, g))), 4) AS error FROM documents d LEFT JOIN m USING (source) CROSS JOIN g WHERE doc_id % 5 = 0 GROUP BY lang",
)
def group_median_error(spark, sf_dir):
    """Held-out error of the group's median, of the overall one where the group has under three members."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    known = docs.where("doc_id % 5 <> 0")
    medians = selection.quantiles(known, ["source"], "n_chars", [0.5]).select("source", F.col("quantiles")[0].alias("m"), "n")
    overall = selection.quantiles(known, [], "n_chars", [0.5]).select(F.col("quantiles")[0].alias("g"))
    held = docs.where("doc_id % 5 = 0").join(medians, "source", "left").crossJoin(F.broadcast(overall))
    return held.groupBy("lang").agg(F.round(F.avg(F.abs(F.col("n_chars") - F.coalesce(F.when(F.col("n") >= 3, F.col("m")), "g"))), 4).alias("error"))


@query("bump_confirmation", f"WITH {FRAMES}, b AS (SELECT id, device, us, gm > 180 AND value > 6 AS flag FROM frames WHERE source = 'rtc'), i AS (SELECT *, sum(CAST(NOT flag AS INTEGER)) OVER (PARTITION BY device ORDER BY us, id) AS island FROM b) SELECT id, flag AND count(*) FILTER (flag) OVER (PARTITION BY device, island ORDER BY us, id) >= 2 AS confirmed FROM i")
def bump_confirmation(spark, sf_dir):
    """Two flagged timer frames in a row."""
    w = Window.partitionBy("device").orderBy("us", "id")
    flagged = frames(spark, sf_dir).where("source = 'rtc'").select("id", "device", "us", ((F.col("gm") > 180) & (F.col("value") > 6)).alias("flag"))
    islands = flagged.withColumn("island", F.sum((~F.col("flag")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.count_if("flag").over(Window.partitionBy("device", "island").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0))
    return islands.select("id", (F.col("flag") & (run >= 2)).alias("confirmed"))
