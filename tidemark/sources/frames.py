"""The event table in the shape of a camera's frame log: a fixed shell and a JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document(text: Column) -> Column:
    """Tolerant JSON ingest, whatever the session's settings: of a repeated key of the document the last value counts, as a
    builder that appends keys again means it, and what doesn't parse is an empty document. A variant parser refuses
    repeated keys by default; only such rows are read again as pairs, of which those that no later pair of that key follows
    make the document. A key that is repeated deeper than in the document itself makes it an empty one."""
    pairs = F.map_entries(F.from_json(text, "map<string,variant>"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.coalesce(F.try_parse_json(text), F.to_variant_object(F.map_from_entries(last)), F.parse_json(F.lit("{}")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, device, captured_at, us, source, result, label, gm, value, k): hot keys of the document are promoted to
    columns. source is pir, rtc or missing; result and label may be missing; gm is a brightness of 0 to 255."""
    k = F.variant_get(document(F.col("props")), "$.k", "bigint")
    at = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("device"), at.alias("captured_at"), F.unix_micros(at).alias("us"),
        F.when(F.col("event_type") == "view", "rtc").when(F.col("event_type") != "error", "pir").alias("source"),
        F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 3 == 0, "clouds").when(F.col("k") % 5 == 0, "batched").otherwise("process").alias("result"),
        F.when(F.col("k") % 13 == 0, "bird").when(F.col("k") % 11 == 0, "ignore").when(F.col("k") % 17 == 0, "special").alias("label"),
        (F.floor(F.col("value") * 10) % 256).alias("gm"), "value", "k",
    )


#: The same as a common table expression of DuckDB.
FRAMES = """frames AS (SELECT event_id AS id, user_id AS device, ts AS captured_at, epoch_us(ts) AS us,
 CASE WHEN event_type = 'view' THEN 'rtc' WHEN event_type <> 'error' THEN 'pir' END AS source,
 CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 'clouds' WHEN k % 5 = 0 THEN 'batched' ELSE 'process' END AS result,
 CASE WHEN k % 13 = 0 THEN 'bird' WHEN k % 11 = 0 THEN 'ignore' WHEN k % 17 = 0 THEN 'special' END AS label,
 CAST(floor(value * 10) AS BIGINT) % 256 AS gm, value, k
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
