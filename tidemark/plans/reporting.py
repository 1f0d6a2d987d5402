"""Queries of the reports: buckets, pages, filters, neighbours, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import buckets, filters, paging
from tidemark.registry import query
from tidemark.sources.frames import FRAMES, document, frames, table
from tidemark.sources.storage import scratch_path

_3H = "us // 10800000000 * 10800"


@query("frames_replayed", f"WITH {FRAMES} SELECT id, us, row_number() OVER (ORDER BY us, id) AS place FROM frames WHERE result IS NOT NULL")
def frames_replayed(spark, sf_dir):
    """All frames in replay order; places count on from one range of times to the next."""
    path = scratch_path(spark, "replay")
    ranged = frames(spark, sf_dir).where("result is not null").select("id", "us").repartitionByRange("us", "id")
    ranged.withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("us", "id"))
    return rows.withColumn("own", own).join(F.broadcast(offsets), "part").select("id", "us", (F.col("before") + F.col("own")).alias("place")).orderBy("us", "id")


@query("typed_document_scan", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS battery FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0")
def typed_document_scan(spark, sf_dir):
    """A typed path of the document, present and over 0."""
    battery = F.variant_get(document(F.col("props")), "$.k", "double")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), battery.alias("battery")).where("battery is not null and battery > 0")


@query("motion_scan", f"WITH {FRAMES} SELECT id, label FROM frames WHERE source = 'pir' AND coalesce(label, '') NOT IN ('ignore', 'delete')")
def motion_scan(spark, sf_dir):
    """S03."""
    return frames(spark, sf_dir).where((F.col("source") == "pir") & ~F.coalesce("label", F.lit("")).isin("ignore", "delete")).select("id", "label")


@query("tolerant_documents", "SELECT event_id AS id, event_id % 10 = 0 AS broken, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def tolerant_documents(spark, sf_dir):
    """Every tenth document is cut off; it reads as an empty one."""
    events = table(spark, sf_dir, "events")
    broken = F.col("event_id") % 10 == 0
    text = F.when(broken, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return events.select(F.col("event_id").alias("id"), broken.alias("broken"), F.variant_get(document(text), "$.k", "bigint").alias("k"))


@query("voltage_buckets", f"WITH {FRAMES} SELECT {_3H} AS bucket, round(avg(value), 3) AS voltage, count(*) AS events FROM frames GROUP BY 1")
def voltage_buckets(spark, sf_dir):
    """A01."""
    return frames(spark, sf_dir).groupBy(buckets.bucket(F.col("us")).alias("bucket")).agg(F.round(F.avg("value"), 3).alias("voltage"), F.count("*").alias("events"))


@query("result_buckets", f"WITH {FRAMES} SELECT {_3H} AS bucket, count(*) FILTER (result = 'clouds') AS clouds, count(*) FILTER (result IS DISTINCT FROM 'clouds') AS process FROM frames GROUP BY 1")
def result_buckets(spark, sf_dir):
    """A missing result counts as process."""
    clouds = F.col("result").eqNullSafe("clouds")
    return frames(spark, sf_dir).groupBy(buckets.bucket(F.col("us")).alias("bucket")).agg(F.count_if(clouds).alias("clouds"), F.count_if(~clouds).alias("process"))


@query("daily_voltage", f"WITH {FRAMES} SELECT CAST(us // 86400000000 AS BIGINT) AS day, count(*) AS events, round(min(value), 2) AS low, round(avg(value), 2) AS mean, round(max(value), 2) AS high FROM frames GROUP BY 1")
def daily_voltage(spark, sf_dir):
    """A03."""
    v = F.col("value")
    return frames(spark, sf_dir).groupBy(F.floor(F.col("us") / 86400000000).alias("day")).agg(F.count("*").alias("events"), F.round(F.min(v), 2).alias("low"), F.round(F.avg(v), 2).alias("mean"), F.round(F.max(v), 2).alias("high"))


@query("page_count", f"WITH {FRAMES} SELECT count(*) AS frames, CAST(greatest(1, ceil(count(*) / 100.0)) AS BIGINT) AS pages FROM frames WHERE result = 'clouds'")
def page_count(spark, sf_dir):
    """A04."""
    return frames(spark, sf_dir).where("result = 'clouds'").agg(F.count("*").alias("frames"), paging.total_pages(F.count("*")).alias("pages"))


@query("batched_counts", f"WITH {FRAMES} SELECT count(*) FILTER (result = 'batched') AS batched, count(*) FILTER (result = 'batched' AND label = 'bird') AS birds FROM frames")
def batched_counts(spark, sf_dir):
    """A05."""
    batched = F.col("result") == "batched"
    return frames(spark, sf_dir).agg(F.count_if(batched).alias("batched"), F.count_if(batched & (F.col("label") == "bird")).alias("birds"))


@query(
    "voltage_spine",
    f"""WITH {FRAMES}, v AS (SELECT {_3H} AS bucket, round(avg(value), 3) AS voltage FROM frames WHERE id % 40 = 0 GROUP BY 1), p AS (SELECT {_3H} AS bucket, count(*) FILTER (result = 'clouds') AS clouds, count(*) AS photos FROM frames GROUP BY 1),
s AS (SELECT unnest(range(min(bucket), max(bucket) + 1, 10800)) AS bucket FROM p),
j AS (SELECT s.bucket, voltage IS NULL AS estimated, last_value(voltage IGNORE NULLS) OVER (ORDER BY s.bucket ROWS UNBOUNDED PRECEDING) AS voltage, coalesce(photos, 0) AS photos, coalesce(clouds, 0) AS clouds FROM s LEFT JOIN v USING (bucket) LEFT JOIN p USING (bucket))
SELECT * FROM j WHERE voltage IS NOT NULL""",
)
def voltage_spine(spark, sf_dir):
    """All buckets, the voltage (known of some frames) carried forward."""
    f = frames(spark, sf_dir).withColumn("bucket", buckets.bucket(F.col("us")))
    ends = f.agg(F.min("bucket"), F.max("bucket")).first()
    if ends[0] is None:
        return spark.createDataFrame([], "bucket long, voltage double, estimated boolean, photos long, clouds long")
    volts = f.where(F.col("id") % 40 == 0).groupBy("bucket").agg(F.round(F.avg("value"), 3).alias("voltage"))
    photos = f.groupBy("bucket").agg(F.count("*").alias("photos"), F.count_if(F.col("result") == "clouds").alias("clouds"))
    joined = buckets.spine(spark, *ends).join(volts, "bucket", "left").join(photos, "bucket", "left").fillna(0, ["photos", "clouds"])
    return buckets.filled(joined, "voltage").select("bucket", "estimated", "voltage", "photos", "clouds")


@query("source_filters", f"WITH {FRAMES} SELECT 'pir' AS active, id FROM frames WHERE source = 'pir' OR source IS NULL UNION ALL SELECT 'rtc', id FROM frames WHERE source = 'rtc'")
def source_filters(spark, sf_dir):
    """P01; both options give all rows, none gives none."""
    f = frames(spark, sf_dir)
    parts = [f.where(filters.source_filter(filters.selected(x, filters.SOURCES))).select(F.lit(x).alias("active"), "id") for x in ("pir", "rtc", "")]
    return parts[0].union(parts[1]).union(parts[2])


_LABELS = {
    "none": "label IS NULL AND result <> 'clouds' AND result <> 'batched'",
    "cloud,bird": "label = 'bird' OR result = 'clouds'",
    "batched,special": "label = 'special' OR result = 'batched'",
    "ignore": "label = 'ignore'",
}


@query("label_filters", f"WITH {FRAMES} " + " UNION ALL ".join(f"SELECT '{k}' AS active, id FROM frames WHERE {v}" for k, v in _LABELS.items()))
def label_filters(spark, sf_dir):
    """Options joined by or; frames without a result are in none of them."""
    f = frames(spark, sf_dir)
    options = ("cloud", "none", "batched", *filters.LABELS)
    parts = [f.where(filters.label_filter(filters.selected(x, options))).select(F.lit(x).alias("active"), "id") for x in _LABELS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("detail_filter", f"WITH {FRAMES} SELECT id FROM frames WHERE label = 'bird' OR (label IS NULL AND result <> 'clouds')")
def detail_filter(spark, sf_dir):
    """Without the batched option, none keeps batched frames."""
    return frames(spark, sf_dir).where(filters.label_filter({"bird", "none"}, batched=False)).select("id")


@query("id_and_time_range", f"WITH {FRAMES} SELECT id, us FROM frames WHERE id BETWEEN 100 AND 5000 AND us >= 1704067200000000 AND result IS NOT NULL")
def id_and_time_range(spark, sf_dir):
    """P05."""
    return frames(spark, sf_dir).where("id between 100 and 5000 and us >= 1704067200000000 and result is not null").select("id", "us")


@query("model_update_gate", f"WITH {FRAMES} SELECT id, coalesce(source = 'rtc' AND (gm < 70 OR result = 'clouds'), false) AS updates, source IS NOT DISTINCT FROM 'rtc' AS updates_always FROM frames")
def model_update_gate(spark, sf_dir):
    """The gate of the live path, and the one of the parity replay."""
    stage = F.when(F.col("gm") < 70, "NIGHT").otherwise("SAFE")
    gate = filters.updates_model(F.col("result"), stage, F.col("source"))
    return frames(spark, sf_dir).select("id", F.coalesce(gate, F.lit(False)).alias("updates"), F.col("source").eqNullSafe("rtc").alias("updates_always"))


@query("array_length_guard", "SELECT vec_id, len(embedding) AS n FROM embeddings WHERE len(embedding) = 64")
def array_length_guard(spark, sf_dir):
    """P07."""
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.size("embedding").alias("n"))


@query("excluded_labels", f"WITH {FRAMES} SELECT id FROM frames WHERE lower(coalesce(label, 'none')) NOT IN ('ignore', 'special')")
def excluded_labels(spark, sf_dir):
    """P08."""
    return frames(spark, sf_dir).where(~F.lower(F.coalesce("label", F.lit("none"))).isin("ignore", "special")).select("id")


@query("label_validation", f"WITH {FRAMES} SELECT coalesce(label, '') AS label, coalesce(label, '') IN ('bird', 'ignore', 'special', '') AS valid, count(*) AS frames FROM frames GROUP BY 1")
def label_validation(spark, sf_dir):
    """P09."""
    label = F.coalesce("label", F.lit(""))
    return frames(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("frames")).select("label", F.col("label").isin("", *filters.LABELS).alias("valid"), "frames")


@query("relative_times", "SELECT * FROM (VALUES ('now', 1704153600), ('-6h', 1704132000), ('-2d', 1703980800), ('2024-01-01 12:00:00', 1704110400), ('nonsense', NULL)) t(literal, epoch)")
def relative_times(spark, sf_dir):
    """P10, against a fixed present."""
    from tidemark.functions.scalars import relative_time

    rows = spark.createDataFrame([("now",), ("-6h",), ("-2d",), ("2024-01-01 12:00:00",), ("nonsense",)], "literal string")
    return rows.select("literal", relative_time(F.col("literal"), F.lit(1704153600)).cast("int").alias("epoch"))


@query("every_nth", f"WITH {FRAMES}, r AS (SELECT id, row_number() OVER (PARTITION BY device ORDER BY us, id) AS n FROM frames) SELECT id, n FROM r WHERE (n - 1) % 50 = 0")
def every_nth(spark, sf_dir):
    """A sampling operator."""
    w = Window.partitionBy("device").orderBy("us", "id")
    return frames(spark, sf_dir).select("id", F.row_number().over(w).alias("n")).where((F.col("n") - 1) % 50 == 0)


@query("hash_holdout", "SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT % 5 = 0 AS held_out FROM labels")
def hash_holdout(spark, sf_dir):
    """A fifth by hash, the same in every run."""
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("long")
    return table(spark, sf_dir, "labels").select("doc_id", (draw % 5 == 0).alias("held_out"))


@query("night_gate", f"WITH {FRAMES} SELECT CASE WHEN gm < 70 THEN 'NIGHT' ELSE 'DAY' END AS branch, count(*) AS frames, round(avg(gm), 4) AS brightness FROM frames GROUP BY 1")
def night_gate(spark, sf_dir):
    """P18."""
    return frames(spark, sf_dir).groupBy(F.when(F.col("gm") < 70, "NIGHT").otherwise("DAY").alias("branch")).agg(F.count("*").alias("frames"), F.round(F.avg("gm"), 4).alias("brightness"))


@query("photo_buckets", f"WITH {FRAMES} SELECT CASE WHEN gm >= 160 THEN 'BRIGHT' WHEN gm < 80 THEN 'LOWLIGHT' ELSE 'NORMAL' END AS bucket, count(*) AS frames FROM frames GROUP BY 1")
def photo_buckets(spark, sf_dir):
    """P13."""
    from tidemark.operators.cascades import photo_bucket

    return frames(spark, sf_dir).groupBy(photo_bucket(F.col("gm")).alias("bucket")).agg(F.count("*").alias("frames"))


@query("gallery_filters", f"WITH {FRAMES} SELECT id, label = 'bird' AS bird, label = 'bird' AND result = 'clouds' AS missed, source = 'rtc' AND result = 'process' AS false_positive FROM frames WHERE label = 'bird' OR (source = 'rtc' AND result = 'process')")
def gallery_filters(spark, sf_dir):
    """P15."""
    bird, clouds = F.col("label") == "bird", F.col("result") == "clouds"
    false = (F.col("source") == "rtc") & (F.col("result") == "process")
    return frames(spark, sf_dir).where(bird | false).select("id", bird.alias("bird"), (bird & clouds).alias("missed"), false.alias("false_positive"))


@query("third_page", f"WITH {FRAMES}, r AS (SELECT id, us, row_number() OVER (ORDER BY us DESC, id DESC) AS n, count(*) OVER () AS c FROM frames WHERE source = 'rtc') SELECT id, us FROM r WHERE (n - 1) // 100 = least(2, (c - 1) // 100)")
def third_page(spark, sf_dir):
    """Newest first, with the id as tiebreak; the last page if there are fewer."""
    rows = frames(spark, sf_dir).where("source = 'rtc'").select("id", "us")
    return paging.page(rows, [F.desc_nulls_first("us"), F.desc("id")], 3)


@query("latest_frame", f"WITH {FRAMES} SELECT device, max(us) AS us, arg_max(id, us) AS id FROM frames GROUP BY device")
def latest_frame(spark, sf_dir):
    """L05, of each device."""
    return frames(spark, sf_dir).groupBy("device").agg(F.max("us").alias("us"), F.max_by("id", "us").alias("id"))


@query("largest_jumps", f"WITH {FRAMES}, j AS (SELECT id, us, abs(gm - lag(gm) OVER (PARTITION BY device ORDER BY us, id)) AS jump FROM frames) SELECT id, us, jump FROM (SELECT * FROM j WHERE jump IS NOT NULL ORDER BY jump DESC, id LIMIT 20) ORDER BY us")
def largest_jumps(spark, sf_dir):
    """The 20 largest, then by time."""
    w = Window.partitionBy("device").orderBy("us", "id")
    jumps = frames(spark, sf_dir).select("id", "us", F.abs(F.col("gm") - F.lag("gm").over(w)).alias("jump")).where("jump is not null")
    return jumps.orderBy(F.desc("jump"), "id").limit(20).orderBy("us")


@query("ranked_configurations", f"WITH {FRAMES} SELECT k, count(*) FILTER (label = 'bird') AS hits, count(*) AS frames, row_number() OVER (ORDER BY count(*) FILTER (label = 'bird') DESC, count(*), k) AS place FROM frames GROUP BY k")
def ranked_configurations(spark, sf_dir):
    """By two keys."""
    by = frames(spark, sf_dir).groupBy("k").agg(F.count_if(F.col("label") == "bird").alias("hits"), F.count("*").alias("frames"))
    return by.select("k", "hits", "frames", F.row_number().over(Window.orderBy(F.desc("hits"), "frames", "k")).alias("place"))


@query("order_with_fallback", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(CASE WHEN lang = 'en' THEN CAST(n_chars AS VARCHAR) END, lang), doc_id) AS place FROM documents")
def order_with_fallback(spark, sf_dir):
    """A key, or another one where it is missing."""
    key = F.coalesce(F.when(F.col("lang") == "en", F.col("n_chars").cast("string")), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(key, "doc_id")).alias("place"))


@query("filtered_neighbours", f"WITH {FRAMES} SELECT id, lag(id) OVER (PARTITION BY device ORDER BY id) AS previous, lead(id) OVER (PARTITION BY device ORDER BY id) AS next FROM frames WHERE result = 'clouds'")
def filtered_neighbours(spark, sf_dir):
    """Neighbours by id, after the filter."""
    w = Window.partitionBy("device").orderBy("id")
    return frames(spark, sf_dir).where("result = 'clouds'").select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


@query("previous_frames", f"WITH {FRAMES} SELECT id, lag(id) OVER w AS prev_id, lag(gm) OVER w AS prev_gm, gm - lag(gm) OVER w AS gm_diff FROM frames WINDOW w AS (PARTITION BY device ORDER BY us, id)")
def previous_frames(spark, sf_dir):
    """J01."""
    from tidemark.operators.sequence import with_previous

    return with_previous(frames(spark, sf_dir), ["id", "gm"]).select("id", F.col("prev.id").alias("prev_id"), F.col("prev.gm").alias("prev_gm"), (F.col("gm") - F.col("prev.gm")).alias("gm_diff"))


@query("previous_in_cell", f"WITH {FRAMES} SELECT id, last_value(CASE WHEN result IS DISTINCT FROM 'clouds' THEN id END IGNORE NULLS) OVER (PARTITION BY device, gm >= 160 ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM frames")
def previous_in_cell(spark, sf_dir):
    """The last frame before that was not suppressed, by device and brightness bucket."""
    from tidemark.operators.sequence import last_before

    w = Window.partitionBy("device", F.col("gm") >= 160).orderBy("us", "id")
    usable = F.when(~F.col("result").eqNullSafe("clouds"), F.col("id"))
    return frames(spark, sf_dir).select("id", last_before(usable, w).alias("previous"))


@query("warmup_left", f"WITH {FRAMES} SELECT id, greatest(0, 5 - coalesce(sum(CAST(source IS NOT DISTINCT FROM 'rtc' AS INTEGER)) OVER (PARTITION BY device ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS warmup FROM frames")
def warmup_left(spark, sf_dir):
    """Counts updates, not observations."""
    w = Window.partitionBy("device").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(F.col("source").eqNullSafe("rtc").cast("int")).over(w), F.lit(0))
    return frames(spark, sf_dir).select("id", F.greatest(F.lit(0), 5 - done).alias("warmup"))


@query("drift", f"WITH {FRAMES}, d AS (SELECT device, id, sum(gm - 128) OVER (PARTITION BY device ORDER BY us, id) AS drift, row_number() OVER (PARTITION BY device ORDER BY us, id) - 1 AS r, count(*) OVER (PARTITION BY device) AS n FROM frames) SELECT device, id, drift FROM d WHERE list_contains(list_transform(range(12), lambda i: CAST(floor(i * (n - 1) / 11) AS BIGINT)), r)")
def drift(spark, sf_dir):
    """A running sum, at 12 evenly spaced rows of each device."""
    w = Window.partitionBy("device").orderBy("us", "id")
    rows = frames(spark, sf_dir).select("device", "id", F.sum(F.col("gm") - 128).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("drift"), (F.row_number().over(w) - 1).alias("r"), F.count("*").over(Window.partitionBy("device")).alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.floor(i * (F.col("n") - 1) / 11))
    return rows.where(F.array_contains(picks, F.col("r").cast("long"))).select("device", "id", "drift")


@query(
    "human_times",
    f"WITH {FRAMES}, s AS (SELECT id, (1735689600000000 - us) // 1000000 AS s FROM frames) SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' WHEN s < 86400 THEN s // 3600 || 'h ' || (s % 3600) // 60 || 'm' ELSE s // 86400 || 'd ' || (s % 86400) // 3600 || 'h' END AS since FROM s",
)
def human_times(spark, sf_dir):
    """W10."""
    from tidemark.functions.scalars import human_time

    return frames(spark, sf_dir).select("id", human_time(F.floor((F.lit(1735689600000000) - F.col("us")) / 1000000)).alias("since"))


@query("union_of_sources", "SELECT doc_id, 'short' AS part FROM documents WHERE n_chars < 500 UNION ALL SELECT doc_id, 'german' FROM documents WHERE lang = 'de'")
def union_of_sources(spark, sf_dir):
    """U01."""
    docs = table(spark, sf_dir, "documents")
    return docs.where("n_chars < 500").select("doc_id", F.lit("short").alias("part")).unionByName(docs.where("lang = 'de'").select("doc_id", F.lit("german").alias("part")))


@query(
    "histogram_difference",
    f"WITH {FRAMES}, a AS (SELECT result AS stage, count(*) AS n FROM frames WHERE source = 'pir' AND result IS NOT NULL GROUP BY 1), b AS (SELECT CASE WHEN gm < 70 THEN 'NIGHT' ELSE result END AS stage, count(*) AS n FROM frames WHERE source = 'rtc' AND result IS NOT NULL GROUP BY 1) SELECT stage, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (stage)",
)
def histogram_difference(spark, sf_dir):
    """Over the union of both runs' stages."""
    f = frames(spark, sf_dir).where("result is not null")
    a = f.where("source = 'pir'").groupBy(F.col("result").alias("stage")).agg(F.count("*").alias("before"))
    b = f.where("source = 'rtc'").groupBy(F.when(F.col("gm") < 70, "NIGHT").otherwise(F.col("result")).alias("stage")).agg(F.count("*").alias("after"))
    both = a.join(b, "stage", "full").fillna(0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before"))


@query("stage_sets", "SELECT doc_id, list_sort(list_filter(['DARK', 'NIGHT', 'QUIET', 'WARMUP'], lambda x: x <> s)) AS active, list_contains(['DARK', 'QUIET'], s) AS core FROM (SELECT doc_id, ['DARK', 'NIGHT', 'QUIET', 'WARMUP'][1 + doc_id % 4] AS s FROM documents)")
def stage_sets(spark, sf_dir):
    """All stages but one; membership."""
    every = F.array(*map(F.lit, ("DARK", "NIGHT", "QUIET", "WARMUP")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.element_at(every, (F.col("doc_id") % 4 + 1).cast("int")).alias("s"))
    return docs.select("doc_id", F.sort_array(F.array_except(every, F.array("s"))).alias("active"), F.col("s").isin("DARK", "QUIET").alias("core"))


@query("distinct_values", f"WITH {FRAMES} SELECT count(DISTINCT gm) AS brightnesses, count(DISTINCT device) AS devices, count(DISTINCT label) AS labels FROM frames")
def distinct_values(spark, sf_dir):
    """U06."""
    return frames(spark, sf_dir).agg(F.countDistinct("gm").alias("brightnesses"), F.countDistinct("device").alias("devices"), F.countDistinct("label").alias("labels"))


@query("export_list", f"WITH {FRAMES} SELECT label, count(*) AS count, list(id ORDER BY us, id) AS frames FROM frames WHERE label IS NOT NULL AND result IS DISTINCT FROM 'batched' GROUP BY label")
def export_list(spark, sf_dir):
    """Labelled frames that were not taken yet, in order. Ids alone are gathered, by label."""
    rows = frames(spark, sf_dir).where(F.col("label").isNotNull() & ~F.col("result").eqNullSafe("batched"))
    ordered = F.array_sort(F.collect_list(F.struct("us", "id")))
    return rows.groupBy("label").agg(F.count("*").alias("count"), F.transform(ordered, lambda x: x["id"]).alias("frames"))


@query("point_lookup", f"WITH {FRAMES} SELECT id, device, us, result FROM frames WHERE id = 123")
def point_lookup(spark, sf_dir):
    """No row is a miss."""
    return frames(spark, sf_dir).where("id = 123").select("id", "device", "us", "result")


@query("not_yet_local", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def not_yet_local(spark, sf_dir):
    """What the local manifest lacks."""
    local = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(local, "o_orderkey", "left_anti")


@query("labelled_folders", "SELECT source AS folder, CASE source WHEN 'src0' THEN 'clouds' WHEN 'src1' THEN 'birds' WHEN 'src2' THEN 'people' ELSE 'other' END AS domain, CASE source WHEN 'src0' THEN 'clouds' ELSE 'process' END AS label, count(*) AS samples FROM documents GROUP BY source")
def labelled_folders(spark, sf_dir):
    """Folder names give domain and label; the dictionary is four rows."""
    names = spark.createDataFrame([("src0", "clouds", "clouds"), ("src1", "birds", "process"), ("src2", "people", "process")], "folder string, domain string, label string")
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("samples"))
    return counts.join(names, "folder", "left").select("folder", F.coalesce("domain", F.lit("other")).alias("domain"), F.coalesce("label", F.lit("process")).alias("label"), "samples")
