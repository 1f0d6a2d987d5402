"""Queries of grid kernels, background folds and cascades. Embeddings of 64 values stand for grids of 8 by 8, scaled to
brightness steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import background as B
from tidemark.operators import cascades as C
from tidemark.operators import grid as G
from tidemark.operators import recurrence as R
from tidemark.operators import retrieval, selection
from tidemark.registry import query
from tidemark.sources.frames import FRAMES, frames, table

H = W = 8
#: Grids as brightness: 128 and 200 times the value, rounded down to whole steps.
_CELLS = "g AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS i, floor(128 + 200 * CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings)"
#: The model of a label: the mean of its grids, cell by cell.
_MODEL = f"{_CELLS}, m AS (SELECT label, i, avg(x) AS m FROM g GROUP BY label, i), j AS (SELECT g.id, g.label, g.i, g.x, m.m FROM g JOIN m ON g.label = m.label AND g.i = m.i)"


def _grids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: F.floor(128 + 200 * x.cast("double")).cast("double")).alias("tile"))


def _models(grids):
    """Element-wise means by label, one row for each label and cell in the shuffle."""
    cells = grids.select("label", F.posexplode("tile").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("model"))


def _joined(spark, sf_dir):
    grids = _grids(spark, sf_dir)
    return grids.join(_models(grids), "label")


@query("mean_grids", f"WITH {_CELLS} SELECT label, i, round(avg(x), 6) AS mean FROM g GROUP BY label, i")
def mean_grids(spark, sf_dir):
    """A18."""
    return _models(_grids(spark, sf_dir)).select("label", F.posexplode("model").alias("i", "m")).select("label", "i", F.round("m", 6).alias("mean"))


@query("median_grids", f"WITH {_CELLS}, m AS (SELECT label, i, median(x) AS m FROM g GROUP BY label, i) SELECT label, i, m AS median, round(median(abs(x - m)) * 1.4826, 6) AS mad FROM g JOIN m USING (label, i) GROUP BY label, i, m")
def median_grids(spark, sf_dir):
    """Exact medians and deviations from them, however many grids a label has."""
    cells = _grids(spark, sf_dir).select("label", F.posexplode("tile").alias("i", "x"))
    return selection.median_and_deviation(cells, ["label", "i"], "x").select("label", "i", "median", F.round("mad", 6).alias("mad"))


#: The brightness of a grid's quarters, by rows and columns of four.
_QUARTERS = ", ".join(f"sum(x) FILTER (i // 32 = {r} AND i % 8 // 4 = {c}) AS q{r}{c}" for r in (0, 1) for c in (0, 1))
_APART = " + ".join(f"power(a.q{r}{c} - b.q{r}{c}, 2)" for r in (0, 1) for c in (0, 1))


@query(
    "retrieved_background",
    f"""WITH {_CELLS.replace("g AS (", "g AS MATERIALIZED (", 1)}, f AS (SELECT id, label, {_QUARTERS} FROM g GROUP BY id, label), p AS (SELECT a.id, b.id AS match, {_APART} AS d FROM f a JOIN f b ON a.label = b.label AND b.id <= a.id - 10),
  k AS MATERIALIZED (SELECT id, match FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, match) AS place FROM p) WHERE place <= 5), m AS MATERIALIZED (SELECT k.id, g.i, median(x) AS m, count(*) AS n FROM k JOIN g ON g.id = k.match GROUP BY k.id, g.i),
  s AS MATERIALIZED (SELECT m.id, m.i, m, n, 1.4826 * median(abs(x - m)) AS mad FROM (SELECT k.id AS asks, g.i, g.x FROM k JOIN g ON g.id = k.match) o5 JOIN m ON m.id = o5.asks AND m.i = o5.i GROUP BY m.id, m.i, m, n), om AS (SELECT i, median(x) AS m FROM g GROUP BY i), o AS (SELECT i, m, 1.4826 * median(abs(x - m)) AS mad FROM g JOIN om USING (i) GROUP BY i, m),
  j AS (SELECT g.id, coalesce(n, 0) AS n, abs(x - CASE WHEN n >= 3 THEN s.m ELSE o.m END) AS gap, CASE WHEN n >= 3 THEN s.mad ELSE o.mad END AS mad FROM g JOIN o USING (i) LEFT JOIN s ON s.id = g.id AND s.i = g.i) SELECT id, n AS members, round(avg(gap), 6) AS error, count(*) FILTER (gap > 3 * greatest(mad, 3)) AS odd FROM j GROUP BY id, n""",
)
def retrieved_background(spark, sf_dir):
    """Each grid against the medians and deviations of the 5 earlier grids of its label, at least 10 before, whose
    quarters are most alike; against those of all grids where there are under three."""
    grids = _grids(spark, sf_dir)
    quarter = lambda r, c: G.total(F.filter("tile", lambda x, i: (F.floor(i / 32) == r) & (F.floor(i % 8 / 4) == c)))
    described = grids.select("id", "label", F.array(*[quarter(r, c) for r in (0, 1) for c in (0, 1)]).alias("quarters"))
    found = retrieval.nearest_past(described, "quarters", ["label"], "id", "id", 5, lag=10)
    model = retrieval.retrieved(found, grids, "id", "tile", H * W)
    overall = selection.median_and_deviation(grids.select(F.posexplode("tile").alias("i", "x")), ["i"], "x")
    sorted_ = F.array_sort(F.collect_list(F.struct("i", "median", "mad")))
    one = overall.agg(sorted_.alias("all")).select(F.col("all.median").alias("all_median"), F.col("all.mad").alias("all_mad"))
    met = grids.join(model, "id", "left").crossJoin(F.broadcast(one)).withColumn("enough", F.coalesce("members", F.lit(0)) >= 3)
    told = met.select("id", F.coalesce("members", F.lit(0)).alias("members"), "tile", F.when(F.col("enough"), F.col("median")).otherwise(F.col("all_median")).alias("m"), F.when(F.col("enough"), F.col("mad")).otherwise(F.col("all_mad")).alias("mad"))
    gaps = told.select("id", "members", "mad", F.zip_with("tile", "m", lambda x, m: F.abs(x - m)).alias("gap"))
    odd = G.count_where(F.zip_with("gap", "mad", lambda g, d: g > 3 * F.greatest(d, F.lit(3.0))), lambda b: b)
    return gaps.select("id", "members", F.round(G.mean(F.col("gap")), 6).alias("error"), odd.cast("long").alias("odd"))


@query("block_statistics", f"WITH {_CELLS} SELECT id, CAST(i // 16 AS INTEGER) AS ty, CAST(i % 8 // 2 AS INTEGER) AS tx, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, CAST(floor(avg(x)) AS BIGINT) AS truncated FROM g GROUP BY 1, 2, 3")
def block_statistics(spark, sf_dir):
    """Blocks of 2 by 2 pixels."""
    pixels = _grids(spark, sf_dir).select("id", F.posexplode("tile").alias("i", "x"))
    return pixels.groupBy("id", F.expr("cast(i div 16 as int)").alias("ty"), F.expr("cast(i % 8 div 2 as int)").alias("tx")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("deviation"), F.floor(F.avg("x")).alias("truncated"))


@query("grid_percentile_bins", f"WITH {_CELLS}, h AS (SELECT label, CAST(greatest(0, least(255, x)) AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY 1, 2), c AS (SELECT label, bin, sum(n) OVER (PARTITION BY label ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY label) AS total, sum(CASE WHEN bin >= 170 THEN n ELSE 0 END) OVER (PARTITION BY label) AS clipped FROM h) SELECT label, min(bin) FILTER (cum >= total * 70 // 100) AS p70, min(bin) FILTER (cum >= total * 99 // 100) AS p99, CAST(any_value(clipped) AS BIGINT) AS clipped FROM c GROUP BY label")
def grid_percentile_bins(spark, sf_dir):
    """Percentiles as the first bin that reaches the floor of the count; clipped pixels."""
    bins = _grids(spark, sf_dir).select("label", F.explode("tile").alias("x")).groupBy("label", F.greatest(F.lit(0), F.least(F.lit(255), F.col("x").cast("long"))).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")
    cum = bins.select("label", "bin", "n", F.sum("n").over(w.orderBy("bin")).alias("cum"), F.sum("n").over(w).alias("total"))
    first = lambda p: F.min(F.when(F.col("cum") >= F.floor(F.col("total") * p / 100), F.col("bin")))
    return cum.groupBy("label").agg(first(70).alias("p70"), first(99).alias("p99"), F.sum(F.when(F.col("bin") >= 170, F.col("n")).otherwise(0)).alias("clipped"))


@query("dark_anomalies", f"WITH {_MODEL} SELECT id, count(*) FILTER (abs(x - m) / 20.0 > 1.5 AND x < m) AS anomalies, round(avg(CAST(abs(x - m) / 20.0 > 1.5 AND x < m AS INTEGER)), 6) AS ratio FROM j GROUP BY id")
def dark_anomalies(spark, sf_dir):
    """G01, U05."""
    variance = F.array_repeat(F.lit(400.0), H * W)
    mask = G.dark_anomalies(F.col("tile"), F.col("model"), variance, 1.5)
    out = _joined(spark, sf_dir).select("id", mask.alias("mask"))
    return out.select("id", G.count_where(F.col("mask"), lambda m: m).cast("long").alias("anomalies"), F.round(G.share(F.col("mask")), 6).alias("ratio"))


@query("chroma_distances", f"WITH {_MODEL}, d AS (SELECT id, i, x - m AS du, (x - m) * 0.5 + i AS dv FROM j), s AS (SELECT id, du - median(du) OVER (PARTITION BY id) AS du, dv - median(dv) OVER (PARTITION BY id) AS dv FROM d) SELECT id, count(*) FILTER (du * du + dv * dv > 640) AS changed, round(max(du * du + dv * dv), 4) AS most FROM s GROUP BY id")
def chroma_distances(spark, sf_dir):
    """G02, with a second plane made of the first."""
    v = F.transform(F.zip_with("tile", "model", lambda x, m: (x - m) * 0.5), lambda d, i: d + i)
    zero = F.array_repeat(F.lit(0.0), H * W)
    sq = G.chroma_sq(F.col("tile"), v, F.col("model"), zero)
    return _joined(spark, sf_dir).select("id", sq.alias("sq")).select("id", G.count_where(F.col("sq"), lambda x: x > 640).cast("long").alias("changed"), F.round(F.array_max("sq"), 4).alias("most"))


@query("plain_lines", f"WITH {_MODEL} SELECT id, round(regr_slope(x, m), 5) AS a, round(regr_intercept(x, m), 4) AS b FROM j GROUP BY id")
def plain_lines(spark, sf_dir):
    """G03."""
    pairs = F.zip_with("model", "tile", lambda m, t: F.struct(m.alias("x"), t.alias("y")))
    return _joined(spark, sf_dir).select("id", G.line(pairs).alias("l")).select("id", F.round("l.a", 5).alias("a"), F.round("l.b", 4).alias("b"))


@query(
    "trimmed_lines",
    f"""WITH {_MODEL}, v AS (SELECT * FROM j WHERE m > 110), f AS (SELECT id, regr_slope(x, m) AS a, regr_intercept(x, m) AS b, count(*) AS n, stddev_pop(m) AS s FROM v GROUP BY id),
r AS (SELECT v.id, x, m, n, s, row_number() OVER (PARTITION BY v.id ORDER BY abs(x - (a * m + b)), m, x) AS k FROM v JOIN f USING (id)), t AS (SELECT id, regr_slope(x, m) AS a, regr_intercept(x, m) AS b FROM r WHERE n >= 10 AND s > 1 AND k <= greatest(10, floor(n * 0.9)) GROUP BY id)
SELECT i.id, round(coalesce(a, 1.0), 4) AS a, round(coalesce(b, 0.0), 3) AS b FROM (SELECT DISTINCT id FROM g) i LEFT JOIN t USING (id)""",
)
def trimmed_lines(spark, sf_dir):
    """G04."""
    fit = G.trimmed_line(F.col("model"), F.col("tile"), 110.0, 10, 1.0)
    return _joined(spark, sf_dir).select("id", fit.alias("l")).select("id", F.round("l.a", 4).alias("a"), F.round("l.b", 3).alias("b"))


def _blobs(diagonal: bool) -> str:
    near = "abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1" if diagonal else "abs(a.i // 8 - b.i // 8) + abs(a.i % 8 - b.i % 8) <= 1"
    return f"""WITH RECURSIVE {_CELLS}, d AS (SELECT id, i FROM g WHERE x < 118), e AS (SELECT a.id, a.i, b.i AS to_i FROM d a JOIN d b ON a.id = b.id AND {near}),
r AS (SELECT id, i, i AS to_i FROM d UNION SELECT r.id, r.i, e.to_i FROM r JOIN e ON r.id = e.id AND r.to_i = e.i), l AS (SELECT id, i, min(to_i) AS blob FROM r GROUP BY id, i), s AS (SELECT id, blob, count(*) AS n FROM l GROUP BY id, blob)
SELECT g.id, coalesce(max(n), 0) AS largest, count(DISTINCT blob) AS blobs, count(DISTINCT CASE WHEN n >= 3 THEN blob END) AS clear FROM (SELECT DISTINCT id FROM g) g LEFT JOIN s USING (id) GROUP BY g.id"""


def _blob_query(diagonal: bool):
    def run(spark, sf_dir):
        labels = G.components(F.transform("tile", lambda x: x < 118), H, W, diagonal)
        sizes = _grids(spark, sf_dir).select("id", labels.alias("labels")).select("id", G.blob_sizes(F.col("labels")).alias("s"))
        return sizes.select("id", F.coalesce(F.array_max("s"), F.lit(0)).alias("largest"), F.size("s").alias("blobs"), G.count_where(F.col("s"), lambda n: n >= 3).alias("clear"))

    return run


#: Connected components and their sizes, by edges alone and with corners.
blobs_4 = query("blobs_by_edges", _blobs(False))(_blob_query(False))
blobs_8 = query("blobs_by_corners", _blobs(True))(_blob_query(True))

_PADS = {"nearest": "greatest(0, least(7, {}))", "reflect": "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"}


def _blur(padding: str) -> str:
    pad = _PADS[padding]
    return f"""b AS (SELECT c.id, c.i, avg(n.x) AS b FROM g c CROSS JOIN (SELECT a - 1 AS dy, b - 1 AS dx FROM range(3) p(a), range(3) q(b)) o JOIN g n ON n.id = c.id AND n.i = ({pad.format("(c.i // 8 + dy)")}) * 8 + ({pad.format("(c.i % 8 + dx)")}) GROUP BY c.id, c.i)"""


@query("box_blurs", f"WITH {_CELLS}, {_blur('nearest')}, r AS ({_blur('reflect')[6:-1]}) SELECT b.id, round(sum(b.b * (b.i + 1)), 4) AS nearest, round(sum(r.b * (b.i + 1)), 4) AS reflect FROM b JOIN r USING (id, i) GROUP BY b.id")
def box_blurs(spark, sf_dir):
    """Both paddings, as place-weighted sums."""
    digest = lambda p: F.round(G.total(F.transform(G.box_blur(F.col("tile"), H, W, 1, p), lambda x, i: x * (i + 1))), 4)
    return _grids(spark, sf_dir).select("id", digest("nearest").alias("nearest"), digest("reflect").alias("reflect"))


@query("high_frequency", f"WITH {_CELLS}, {_blur('reflect')} SELECT id, round(avg(abs(x - b)), 6) AS energy FROM g JOIN b USING (id, i) GROUP BY id")
def high_frequency(spark, sf_dir):
    """G10."""
    sharp = F.zip_with("tile", G.box_blur(F.col("tile"), H, W, 1, "reflect"), lambda x, b: F.abs(x - b))
    return _grids(spark, sf_dir).select("id", F.round(G.mean(sharp), 6).alias("energy"))


@query("high_pass_delta", f"WITH {_MODEL}, {_blur('nearest')}, mm AS (SELECT id, i, m AS x FROM j), mb AS ({_blur('nearest')[6:-1].replace('FROM g c', 'FROM mm c').replace('JOIN g n', 'JOIN mm n')}) SELECT id, round(max((m - mb.b) - (j.x - b.b)), 5) AS score, count(*) FILTER ((m - mb.b) - (j.x - b.b) >= 25) AS tiles FROM j JOIN b USING (id, i) JOIN mb USING (id, i) GROUP BY id")
def high_pass_delta(spark, sf_dir):
    """G08, and D05's and D06's score."""
    delta = G.high_pass(F.col("tile"), F.col("model"), H, W, 1)
    return _joined(spark, sf_dir).select("id", delta.alias("d")).select("id", F.round(F.array_max("d"), 5).alias("score"), G.count_where(F.col("d"), lambda x: x >= 25).cast("long").alias("tiles"))


@query("brightness_distortion", f"WITH {_MODEL}, a AS (SELECT id, sum(x * m / 25) / sum(m * m / 25) AS alpha FROM j GROUP BY id) SELECT id, round(alpha, 5) AS alpha, count(*) FILTER (abs(x - alpha * m) / 5 > 7.0123) AS distorted FROM j JOIN a USING (id) GROUP BY id, alpha")
def brightness_distortion(spark, sf_dir):
    """The scale that fits the model best, and what is left, with a floor of 3 under deviations."""
    s2 = float(max(3.0, 5.0) ** 2)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # the exact scale has a name of its own: within a lambda, that of the rounded column would mean the rounded one
    rows = _joined(spark, sf_dir).withColumn("scale", dot("tile", "model") / dot("model", "model"))
    cd = F.zip_with("tile", "model", lambda x, m: F.sqrt((x - F.col("scale") * m) * (x - F.col("scale") * m) / s2))
    return rows.select("id", F.round("scale", 5).alias("alpha"), G.count_where(cd, lambda d: d > 7.0123).cast("long").alias("distorted"))


@query("occlusion", f"WITH {_MODEL}, {_blur('reflect')}, h AS (SELECT id, i, abs(j.x - b.b) AS hf, abs(m - b.b) + 1 AS mu FROM j JOIN b USING (id, i)) SELECT id, round(avg(CASE WHEN mu > 2 THEN greatest(0, least(1, 1 - hf / (0.8 * mu + 1e-3))) ELSE 0 END), 6) AS occlusion FROM h GROUP BY id")
def occlusion(spark, sf_dir):
    """How much of the expected structure is missing, where structure is expected."""
    blur = G.box_blur(F.col("tile"), H, W, 1, "reflect")
    rows = _joined(spark, sf_dir).select("id", F.arrays_zip(F.col("tile").alias("x"), F.col("model").alias("m"), blur.alias("b")).alias("cells"))
    part = lambda c: F.when(F.abs(c["m"] - c["b"]) + 1 > 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(c["x"] - c["b"]) / (0.8 * (F.abs(c["m"] - c["b"]) + 1) + 1e-3)))).otherwise(0.0)
    return rows.select("id", F.round(G.mean(F.transform("cells", part)), 6).alias("occlusion"))


@query("suppression_masks", f"WITH {_CELLS}, n AS (SELECT id, i, x, lag(x) OVER r AS l, lead(x) OVER r AS rr, lag(x) OVER c AS u, lead(x) OVER c AS d FROM g WINDOW r AS (PARTITION BY id, i // 8 ORDER BY i), c AS (PARTITION BY id, i % 8 ORDER BY i)), h AS (SELECT id, i, sqrt(power((coalesce(rr, x) - coalesce(l, x)) / (CASE WHEN rr IS NULL OR l IS NULL THEN 1 ELSE 2 END), 2) + power((coalesce(d, x) - coalesce(u, x)) / (CASE WHEN d IS NULL OR u IS NULL THEN 1 ELSE 2 END), 2)) AS gr FROM n), m AS (SELECT a.id, a.i, max(b.gr) AS gm FROM h a JOIN h b ON a.id = b.id AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1 GROUP BY a.id, a.i) SELECT id, round(sum(gm * (i + 1)), 3) AS edges, round(avg(exp(-power(gm / 40, 2))), 6) AS weight FROM m GROUP BY id")
def suppression_masks(spark, sf_dir):
    """G12."""
    edges = G.maximum_filter(G.gradient(F.col("tile"), H, W), H, W)
    rows = _grids(spark, sf_dir).select("id", edges.alias("e"))
    return rows.select("id", F.round(G.total(F.transform("e", lambda x, i: x * (i + 1))), 3).alias("edges"), F.round(G.mean(F.transform("e", lambda x: F.exp(-(x / 40) * (x / 40)))), 6).alias("weight"))


@query("regime_descriptors", f"WITH {_CELLS}, q AS (SELECT id, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM g GROUP BY id) SELECT id, round(avg(x) / 255, 6) AS brightness, round(stddev_pop(x) / 64, 6) AS contrast, round(avg(x) FILTER (x >= hi) / greatest(avg(x) FILTER (x <= lo), 1) / 8, 6) AS harshness FROM g JOIN q USING (id) GROUP BY id")
def regime_descriptors(spark, sf_dir):
    """G13."""
    d = _grids(spark, sf_dir).select("id", G.descriptor(F.col("tile")).alias("d"))
    return d.select("id", *[F.round(F.element_at("d", k + 1), 6).alias(n) for k, n in enumerate(("brightness", "contrast", "harshness"))])


@query("colour_masks", f"WITH {_MODEL}, c AS (SELECT id, CASE WHEN x < m - 30 THEN 2 WHEN x < m - 10 THEN 1 ELSE 0 END AS c FROM j) SELECT id, count(*) FILTER (c = 1) AS dark, count(*) FILTER (c = 2) AS blob FROM c GROUP BY id")
def colour_masks(spark, sf_dir):
    """A blob's colour covers a dark tile's."""
    mask = F.zip_with("tile", "model", lambda x, m: F.when(x < m - 30, 2).when(x < m - 10, 1).otherwise(0))
    return _joined(spark, sf_dir).select("id", mask.alias("c")).select("id", G.count_where(F.col("c"), lambda c: c == 1).cast("long").alias("dark"), G.count_where(F.col("c"), lambda c: c == 2).cast("long").alias("blob"))


@query("tile_colours", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, CASE WHEN l_quantity = 0 THEN 128 ELSE (77 * r + 150 * g + 29 * b) >> 8 END AS y, greatest(0, least(255, ((-43 * r - 85 * g + 128 * b) >> 8) + 128)) AS u FROM (SELECT *, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem)")
def tile_colours(spark, sf_dir):
    """Integer colour sums; a tile without pixels is grey."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", *[(F.col(c) % 256).alias(n) for c, n in (("l_partkey", "r"), ("l_suppkey", "g"), ("l_orderkey", "b"))])
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"), F.expr("if(l_quantity = 0, 128, shiftright(77 * r + 150 * g + 29 * b, 8))").alias("y"), F.expr("greatest(0, least(255, shiftright(-43 * r - 85 * g + 128 * b, 8) + 128))").alias("u"))


@query("exposure_split", f"WITH {FRAMES}, e AS (SELECT id, gm * 20 AS wanted FROM frames) SELECT id, least(wanted, 1200) AS aec, least(8, greatest(1, (wanted + 1199) // 1200)) AS gain FROM e")
def exposure_split(spark, sf_dir):
    """Exposure up to 1200 lines, then gain up to 8."""
    return frames(spark, sf_dir).select("id", (F.col("gm") * 20).alias("wanted")).select("id", F.least("wanted", F.lit(1200)).alias("aec"), F.expr("least(8, greatest(1, (wanted + 1199) div 1200))").alias("gain"))


@query("best_of_bracket", f"WITH {FRAMES}, s AS (SELECT device, us // 86400000000 AS day, id, abs(gm - 110) + greatest(0, k - 90) AS score FROM frames) SELECT device, day, arg_min(id, score * 1000000000 + id) AS id, min(score) AS score FROM s GROUP BY device, day")
def best_of_bracket(spark, sf_dir):
    """The first of the best exposed frames."""
    rows = frames(spark, sf_dir).select("device", F.floor(F.col("us") / 86400000000).alias("day"), "id", (F.abs(F.col("gm") - 110) + F.greatest(F.lit(0), F.col("k") - 90)).alias("score"))
    return rows.groupBy("device", "day").agg(F.min_by("id", F.struct("score", "id")).alias("id"), F.min("score").alias("score"))


@query("exposure_ratios", f"WITH {FRAMES} SELECT id, CASE WHEN gm + 20 < 90 THEN 1.0 WHEN r > 0.9 AND r < 1.1 THEN 1.0 ELSE round(r, 6) END AS ratio FROM (SELECT id, gm, greatest(0.25, least(8.0, CASE WHEN k > 95 THEN least(1.0, 130.0 / greatest(gm, 1)) ELSE 130.0 / greatest(gm, 1) END)) AS r FROM frames)")
def exposure_ratios(spark, sf_dir):
    """G19's formula: towards 130, capped where too much is clipped, clamped, left alone if near 1 or at night."""
    raw = 130.0 / F.greatest("gm", F.lit(1))
    r = F.greatest(F.lit(0.25), F.least(F.lit(8.0), F.when(F.col("k") > 95, F.least(F.lit(1.0), raw)).otherwise(raw)))
    rows = frames(spark, sf_dir).select("id", "gm", r.alias("r"))
    return rows.select("id", F.when((F.col("gm") + 20 < 90) | ((F.col("r") > 0.9) & (F.col("r") < 1.1)), 1.0).otherwise(F.round("r", 6)).alias("ratio"))


@query("score_maps", f"WITH {_MODEL}, s AS (SELECT id, i, greatest(abs(x - m) / 6, CASE WHEN x < m THEN (m - x) / 6 * 1.5 ELSE 0 END) AS x FROM j), {_blur('reflect').replace('FROM g c', 'FROM s c').replace('JOIN g n', 'JOIN s n')} SELECT id, round(max(b), 5) AS top FROM b GROUP BY id")
def score_maps(spark, sf_dir):
    """The larger of two scores, smoothed."""
    scores = F.zip_with("tile", "model", lambda x, m: F.greatest(F.abs(x - m) / 6, F.when(x < m, (m - x) / 6 * 1.5).otherwise(0.0)))
    rows = _joined(spark, sf_dir).select("id", scores.alias("s"))
    return rows.select("id", F.round(F.array_max(G.box_blur(F.col("s"), H, W, 1, "reflect")), 5).alias("top"))


@query("variance_masked_ratio", f"WITH {_CELLS}, m AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s FROM g GROUP BY label, i) SELECT id, round(coalesce(count(*) FILTER (s <= 26 AND x < m - 20) / nullif(count(*) FILTER (s <= 26), 0), 0), 6) AS ratio FROM g JOIN m USING (label, i) GROUP BY id")
def variance_masked_ratio(spark, sf_dir):
    """Over steady cells alone."""
    grids = _grids(spark, sf_dir)
    cells = grids.select("label", F.posexplode("tile").alias("i", "x")).groupBy("label", "i").agg(F.struct(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).alias("c"))
    models = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("cells"))
    steady = F.filter(F.zip_with("tile", "cells", lambda x, c: F.when(c["s"] <= 26, x < c["m"] - 20)), lambda x: x.isNotNull())
    rows = grids.join(models, "label").select("id", steady.alias("a"))
    return rows.select("id", F.round(F.coalesce(F.try_divide(G.count_where(F.col("a"), lambda x: x), F.size("a")), F.lit(0.0)), 6).alias("ratio"))


@query("two_grid_features", f"WITH {_MODEL}, f AS (SELECT id, regr_slope(x, m) AS a, regr_intercept(x, m) AS b, abs(avg(x) - avg(m)) AS gm_diff FROM j GROUP BY id) SELECT id, round(gm_diff, 5) AS gm_diff, round(a, 5) AS slope, count(*) FILTER (abs(x - m) > 12) AS n_changed, round(max(abs(x - (a * m + b))), 4) AS res_max, round(quantile_cont(abs(x - (a * m + b)), 0.95), 4) AS res_p95, round(median(abs(x - (a * m + b))), 4) AS res_median FROM j JOIN f USING (id) GROUP BY id, gm_diff, a, b")
def two_grid_features(spark, sf_dir):
    """G22."""
    pairs = F.zip_with("model", "tile", lambda m, t: F.struct(m.alias("x"), t.alias("y")))
    rows = _joined(spark, sf_dir).select("id", "tile", "model", G.line(pairs).alias("l"), F.abs(G.mean(F.col("tile")) - G.mean(F.col("model"))).alias("gm_diff"))
    res = F.sort_array(F.zip_with("tile", "model", lambda t, m: F.abs(t - (F.col("l.a") * m + F.col("l.b")))))
    rows = rows.select("*", res.alias("res"), G.count_where(F.zip_with("tile", "model", lambda t, m: F.abs(t - m)), lambda d: d > 12).cast("long").alias("n_changed"))
    low, high = F.element_at("res", 60), F.element_at("res", 61)  # 0.95 * 63 = 59.85
    return rows.select("id", F.round("gm_diff", 5).alias("gm_diff"), F.round("l.a", 5).alias("slope"), "n_changed", F.round(F.array_max("res"), 4).alias("res_max"), F.round(low + (high - low) * 0.85, 4).alias("res_p95"), F.round((F.element_at("res", 32) + F.element_at("res", 33)) / 2, 4).alias("res_median"))


def _fold_sql(step: str) -> str:
    return f"""WITH RECURSIVE {FRAMES}, n AS (SELECT device, CAST(gm AS DOUBLE) AS x, row_number() OVER (PARTITION BY device ORDER BY us, id) AS i FROM frames WHERE result = 'clouds'), r AS (SELECT DISTINCT device, CAST(0 AS BIGINT) AS i, CAST(128 AS DOUBLE) AS m, CAST(256 AS DOUBLE) AS v FROM n UNION ALL SELECT n.device, n.i, {step} FROM r JOIN n ON n.device = r.device AND n.i = r.i + 1)
SELECT device, round(arg_max(m, i), 6) AS mean, round(arg_max(v, i), 5) AS variance FROM r GROUP BY device"""


def _emas(spark, sf_dir, west=False):
    clouds = frames(spark, sf_dir).where("result = 'clouds'").select("device", "us", "id", F.col("gm").cast("double").alias("x"))
    return R.ema(clouds, "device", ["us", "id"], "x", west)


def _last_emas(west):
    def run(spark, sf_dir):
        last = F.max_by(F.struct("mean", "variance"), F.struct("us", "id"))
        return _emas(spark, sf_dir, west).groupBy("device").agg(last.alias("s")).select("device", F.round("s.mean", 6).alias("mean"), F.round("s.variance", 5).alias("variance"))

    return run


_AFTER = "0.85 * m + 0.15 * x, greatest(0.85 * v + 0.15 * power(x - (0.85 * m + 0.15 * x), 2), 36.0)"
#: Two estimators of the variance, by scans that split a device's history.
ema_after = query("ema_after_update", _fold_sql(_AFTER))(_last_emas(False))
ema_before = query("ema_before_update", _fold_sql("m + 0.15 * (x - m), 0.85 * (v + 0.15 * (x - m) * (x - m))"))(_last_emas(True))


@query("ema_of_each_frame", _fold_sql(_AFTER).replace("SELECT device, CAST(gm", "SELECT device, id, CAST(gm").replace("SELECT DISTINCT device, CAST(0 AS BIGINT) AS i,", "SELECT DISTINCT device, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id,").replace("SELECT n.device, n.i,", "SELECT n.device, n.i, n.id,").split("\nSELECT device")[0] + "\nSELECT id, round(m, 6) AS mean, round(v, 5) AS variance FROM r WHERE i > 0")
def ema_of_each_frame(spark, sf_dir):
    """The state after each frame."""
    return _emas(spark, sf_dir).select("id", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


@query(
    "scored_background",
    f"""WITH RECURSIVE {FRAMES}, n AS (SELECT device, id, CAST(gm AS DOUBLE) AS x, source IS NOT DISTINCT FROM 'rtc' OR result IS NOT DISTINCT FROM 'clouds' AS teaches, row_number() OVER (PARTITION BY device ORDER BY us, id) AS i FROM frames),
r AS (SELECT DISTINCT device, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(128 AS DOUBLE) AS m, CAST(256 AS DOUBLE) AS v, 0 AS c, CAST(NULL AS DOUBLE) AS z, false AS odd FROM n
UNION ALL SELECT device, i, id, CASE WHEN learn THEN 0.85 * m + 0.15 * x ELSE m END, CASE WHEN learn THEN greatest(0.85 * v + 0.15 * power(x - (0.85 * m + 0.15 * x), 2), 36.0) ELSE v END, c + CAST(learn AS INTEGER), z, odd
FROM (SELECT *, teaches AND NOT odd AS learn FROM (SELECT n.device, n.i, n.id, n.x, n.teaches, m, v, c, abs(n.x - m) / sqrt(v) AS z, abs(n.x - m) / sqrt(v) > 2.0 AND c > 0 AS odd FROM r JOIN n ON n.device = r.device AND n.i = r.i + 1)))
SELECT id, round(z, 5) AS z, odd AS anomalous FROM r WHERE i > 0""",
)
def scored_background(spark, sf_dir):
    """DM5, T01, T03: each frame scored by the state before it, which it may then teach; the decision feeds back."""
    teaches = F.col("source").eqNullSafe("rtc") | F.col("result").eqNullSafe("clouds")
    events = F.array_sort(F.collect_list(F.struct("us", "id", F.col("gm").cast("double").alias("x"), teaches.alias("teaches"))))
    rows = frames(spark, sf_dir).groupBy("device").agg(events.alias("e")).select(F.explode(B.scored(F.col("e"), 2.0)).alias("s"))
    return rows.select("s.id", F.round("s.z", 5).alias("z"), "s.anomalous")


_BURST = f"""{FRAMES}, p AS (SELECT id, gm, result, k, lag(gm) OVER w AS prev_gm, (us - lag(us) OVER w) / 1e6 / 200 AS dt, abs(gm - lag(gm) OVER w) AS gm_diff, k % 3 AS n_changed, k AS n_dark, k % 2 AS n_chroma FROM frames WINDOW w AS (PARTITION BY device ORDER BY us, id))"""
_CASCADES = {
    "python": "CASE WHEN prev_gm IS NULL THEN 'FIRST' WHEN dt > 180 THEN 'ISOLATED' WHEN gm_diff > 12 AND dt < 15 AND gm >= 120 THEN 'FAST_SHIFT' WHEN gm_diff > 12 THEN 'BRIGHTNESS_SHIFT' WHEN n_changed <= 0 AND n_chroma = 0 THEN 'DUPLICATE' WHEN gm > 160 AND n_dark < 35 THEN 'BRIGHT_STABLE' WHEN gm < 70 THEN 'NIGHT' WHEN n_dark >= 60 THEN 'DIFFUSE' ELSE 'SAFE' END",
    "firmware": "CASE WHEN prev_gm IS NULL THEN 'FIRST' WHEN gm_diff > 12 THEN 'BRIGHTNESS_SHIFT' WHEN n_changed <= 0 AND n_chroma = 0 THEN 'DUPLICATE' WHEN gm > 160 AND n_dark < 35 THEN 'BRIGHT_STABLE' WHEN n_dark >= 60 THEN 'DIFFUSE' WHEN gm < 70 THEN 'NIGHT' ELSE 'SAFE' END",
    "minimal": "CASE WHEN prev_gm IS NULL THEN 'FIRST' WHEN dt > 180 THEN 'ISOLATED' WHEN n_changed <= 0 AND n_chroma = 0 THEN 'DUPLICATE' ELSE 'SAFE' END",
}


def _pairs(spark, sf_dir):
    w = Window.partitionBy("device").orderBy("us", "id")
    k = F.col("k")
    return frames(spark, sf_dir).select("id", "gm", "result", F.lag("gm").over(w).alias("prev_gm"), ((F.col("us") - F.lag("us").over(w)) / 1e6 / 200).alias("dt"), F.abs(F.col("gm") - F.lag("gm").over(w)).alias("gm_diff"), (k % 3).alias("n_changed"), k.alias("n_dark"), (k % 2).alias("n_chroma"))


@query("burst_cascades", f"WITH {_BURST} SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in _CASCADES.items()) + ", CASE WHEN python IN ('DUPLICATE', 'BRIGHT_STABLE') THEN 'clouds' WHEN python = 'NIGHT' THEN 'process' ELSE 'classify' END AS route FROM p")
def burst_cascades(spark, sf_dir):
    """D01, D02, D03, D11, with intervals scaled to the fixture."""
    rows = _pairs(spark, sf_dir)
    full = C.burst_filter()
    return rows.select("id", full["trigger"].alias("python"), C.burst_filter(firmware=True)["trigger"].alias("firmware"), C.burst_filter(minimal=True)["trigger"].alias("minimal"), C.routed(full).alias("route"))


@query("background_cascade", f"WITH {FRAMES}, c AS (SELECT id, k, gm / 256.0 AS ratio, k % 9 AS blob, greatest(0, 3 - (row_number() OVER (PARTITION BY device ORDER BY us, id) - 1)) AS warmup FROM frames) SELECT id, CASE WHEN warmup > 0 THEN 'WARMUP' WHEN blob BETWEEN 1 AND 5 THEN 'DARK_BLOB' WHEN ratio <= 0.25 THEN 'QUIET' ELSE 'AMBIGUOUS' END AS trigger, CASE WHEN warmup <= 0 AND NOT coalesce(blob BETWEEN 1 AND 5, false) AND ratio <= 0.25 THEN 'clouds' ELSE 'process' END AS label FROM c")
def background_cascade(spark, sf_dir):
    """A test of D04's rule alone, over made-up figures; `background_pipeline` runs it from kernels."""
    w = Window.partitionBy("device").orderBy("us", "id")
    rows = frames(spark, sf_dir).select("id", (F.col("gm") / 256.0).alias("ratio"), (F.col("k") % 9).alias("blob"), F.greatest(F.lit(0), 4 - F.row_number().over(w)).alias("warmup"))
    out = C.first_match([(F.col("warmup") > 0, "process", "WARMUP"), (F.col("blob").between(1, 5), "process", "DARK_BLOB"), (F.col("ratio") <= 0.25, "clouds", "QUIET")], ("process", "AMBIGUOUS"))
    return rows.select("id", out["trigger"].alias("trigger"), out["label"].alias("label"))


@query("high_pass_cascade", f"WITH {FRAMES} SELECT id, CASE WHEN gm < 70 THEN 'NIGHT' WHEN k % 3 = 0 AND k % 2 = 0 THEN 'DUPLICATE' WHEN k >= 75 OR (k % 10 >= 8 AND k >= 30) THEN 'DARK_BLOB_HP' ELSE 'QUIET_HP' END AS stage, CASE WHEN k >= 75 THEN 'DARK_BLOB_HP' ELSE 'QUIET_HP' END AS blur_stage FROM frames")
def high_pass_cascade(spark, sf_dir):
    """A test of D05's and D06's rules alone, over made-up figures; `high_pass_pipeline` and `blur_pipeline` run them."""
    k, gm = F.col("k"), F.col("gm")
    hp = C.first_match([(gm < 70, "process", "NIGHT"), ((k % 3 == 0) & (k % 2 == 0), "clouds", "DUPLICATE"), ((k >= 75) | ((k % 10 >= 8) & (k >= 30)), "process", "DARK_BLOB_HP")], ("clouds", "QUIET_HP"))
    blur = C.first_match([(k >= 75, "process", "DARK_BLOB_HP")], ("clouds", "QUIET_HP"))
    return frames(spark, sf_dir).select("id", hp["trigger"].alias("stage"), blur["trigger"].alias("blur_stage"))


@query("pixel_cascade", f"WITH {FRAMES} SELECT CASE WHEN gm < 30 THEN 'NIGHT' WHEN id % 50 < 3 THEN 'WARMUP' WHEN k > 95 THEN 'BUMP' WHEN value / 100 > 0.6 THEN 'SCENE_EVENT' WHEN k > 90 THEN 'SCENE_EVENT' WHEN k % 6 = 0 THEN 'BIRD_CANDIDATE' ELSE 'BACKGROUND' END AS decision, count(*) AS frames FROM frames GROUP BY 1")
def pixel_cascade(spark, sf_dir):
    """A test of D07's rule alone, over made-up figures; `pixel_pipeline` runs it from kernels."""
    k = F.col("k")
    stages = [(F.col("gm") < 30, "skip", "NIGHT"), (F.col("id") % 50 < 3, "skip", "WARMUP"), (k > 95, "skip", "BUMP"), (F.col("value") / 100 > 0.6, "keep", "SCENE_EVENT"), (k > 90, "keep", "SCENE_EVENT"), (k % 6 == 0, "keep", "BIRD_CANDIDATE")]
    return frames(spark, sf_dir).groupBy(C.first_match(stages, ("skip", "BACKGROUND"))["trigger"].alias("decision")).agg(F.count("*").alias("frames"))


@query("stage_ablation", f"WITH {FRAMES} SELECT a AS without, CASE WHEN gm < 70 AND a <> 'NIGHT' THEN 'NIGHT' WHEN k % 9 BETWEEN 1 AND 3 AND a <> 'DARK_OBJ' THEN 'DARK_OBJ' WHEN gm < 150 AND a <> 'QUIET' THEN 'QUIET' ELSE 'AMBIGUOUS' END AS stage, count(*) AS frames FROM frames, (SELECT unnest(['NIGHT', 'DARK_OBJ', 'QUIET']) AS a) GROUP BY 1, 2")
def stage_ablation(spark, sf_dir):
    """A test of D10's rule alone, `legacy_ablation` runs the older cascade: the cascade with one stage left out at a time; rows are copied three times and summed up in place."""
    a = F.col("without")
    rows = frames(spark, sf_dir).select("gm", "k", F.explode(F.array(*map(F.lit, ("NIGHT", "DARK_OBJ", "QUIET")))).alias("without"))
    stages = [((F.col("gm") < 70) & (a != "NIGHT"), "process", "NIGHT"), ((F.col("k") % 9).between(1, 3) & (a != "DARK_OBJ"), "process", "DARK_OBJ"), ((F.col("gm") < 150) & (a != "QUIET"), "clouds", "QUIET")]
    return rows.groupBy("without", C.first_match(stages, ("process", "AMBIGUOUS"))["trigger"].alias("stage")).agg(F.count("*").alias("frames"))
