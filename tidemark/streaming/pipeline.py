"""Structured Streaming: sources, sinks, windows and the stateful background."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.background import EmaConfig
from tidemark.sources.frames import document
from tidemark.sources.storage import scratch_path

#: The store that arbitrary state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events file, as (id, device, captured_at, us, source, result, gm, k)."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 4).parquet(sf_dir)
    at = F.col("ts").cast("timestamp")
    k = F.variant_get(document(F.col("props")), "$.k", "bigint")
    rows = raw.select("event_id", "user_id", at.alias("at"), "event_type", "value", k.alias("k"))
    return rows.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("device"), F.col("at").alias("captured_at"), F.unix_micros("at").alias("us"),
        F.when(F.col("event_type") == "view", "rtc").when(F.col("event_type") != "error", "pir").alias("source"),
        F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 3 == 0, "clouds").when(F.col("k") % 5 == 0, "batched").otherwise("process").alias("result"),
        (F.floor(F.col("value") * 10) % 256).alias("gm"), "k",
    )


def drain(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """All that is there now, through the stream, as a table: appended, or the last complete result. `path`: the folder of
    an earlier run, whose checkpoint, state and output go on."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").start(f"{path}/out")
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


STATE = "mean double, variance double, count int"


class _Background(StatefulProcessor):
    """The background of one device in the state store."""

    def __init__(self, z: float, c: EmaConfig):
        self.z, self.c = z, c

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("background", STATE)

    def handleInitialState(self, key: tuple, initial: Row, timers: object) -> None:
        self.state.update((float(initial["mean"]), float(initial["variance"]), int(initial["count"])))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        c = self.c
        start = (c.start_mean, c.start_variance, 0)
        mean, variance, count = self.state.get() or start  # None without a state
        last = lambda v: (v is None, v or 0)
        for _, event, _, gm, teaches, reset in sorted(rows, key=lambda r: (last(r[2]), last(r[1]))):
            if reset:
                mean, variance, count = start
                continue
            x = math.nan if gm is None else float(gm)
            far = abs(x - mean) / variance**0.5
            odd = far > self.z and count > 0
            yield Row(id=event, z=far, anomalous=odd)
            if teaches and not odd:
                mean = (1 - c.alpha) * mean + c.alpha * x
                variance = max((1 - c.alpha) * variance + c.alpha * (x - mean) ** 2, c.floor)
                count = min(count + 1, 65535)
        self.state.update((float(mean), float(variance), int(count)))

    def close(self) -> None:
        pass


def stateful_background(stream: DataFrame, z: float, c: EmaConfig = EmaConfig(), initial: DataFrame | None = None) -> DataFrame:
    """(id, z, anomalous): each event scored by its device's state before it, which it may then teach. The state, four
    numbers for each device, lives in the state store and survives restarts; rows of a device within a batch are put in
    order, a batch behind another is later. A row whose `reset` is true is a control row: it clears its device's state and
    has no result; a stream without the column has none. initial (device, mean, variance, count): states to start from,
    one a device at most, as `learned` gives them for a history."""
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in stream.columns else F.lit(False)
    rows = stream.select("device", "id", "us", "gm", (F.col("source").eqNullSafe("rtc") | F.col("result").eqNullSafe("clouds")).alias("teaches"), reset.alias("reset"))
    states = initial.select("device", "mean", "variance", "count").groupBy("device") if initial is not None else None
    return rows.groupBy("device").transformWithState(_Background(z, c), "id long, z double, anomalous boolean", "append", "none", states)


def learned(history: DataFrame, z: float, c: EmaConfig = EmaConfig()) -> DataFrame:
    """(device, mean, variance, count): the states that a history of frames leaves, by the stream's own rules. A device's
    history is folded by one task, so give it in bounded spans."""
    taught = history.withColumn("teaches", F.col("source").eqNullSafe("rtc") | F.col("result").eqNullSafe("clouds"))

    def step(s: Column, e: Column) -> Column:
        mean = (1 - c.alpha) * s["mean"] + c.alpha * e["x"]
        variance = F.greatest((1 - c.alpha) * s["variance"] + c.alpha * ((e["x"] - mean) * (e["x"] - mean)), F.lit(c.floor))  # the stream's order, to the last bit
        learn = (F.abs(e["x"] - s["mean"]) / F.sqrt(s["variance"]) <= z) | (s["count"] == 0)
        return F.struct(
            F.when(learn, mean).otherwise(s["mean"]).alias("mean"), F.when(learn, variance).otherwise(s["variance"]).alias("variance"),
            F.least(s["count"] + learn.cast("int"), F.lit(65535)).alias("count"),
        )

    start = F.struct(F.lit(c.start_mean).alias("mean"), F.lit(c.start_variance).alias("variance"), F.lit(0).alias("count"))
    ordered = F.array_sort(F.collect_list(F.struct("us", "id", F.col("gm").cast("double").alias("x"))))
    states = taught.where("teaches").groupBy("device").agg(ordered.alias("rows")).select("device", F.aggregate("rows", start, step).alias("state"))
    return states.select("device", "state.*")


def bounded_spool(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """`rows` of a span that couldn't be sent, with kept (the newest `most` of a key) and dropped (how many older ones of the
    key were pushed out)."""
    w = Window.partitionBy(key)
    newest = F.row_number().over(w.orderBy(*[F.desc(o) for o in order]))
    return rows.select("*", (newest <= most).alias("kept"), F.greatest(F.count("*").over(w) - most, F.lit(0)).alias("dropped"))


def flushes(rows: DataFrame, key: str, order: list[str], most: int = 8, seconds: float = 20.0) -> DataFrame:
    """`rows` with flush: the number, from 0, of the delivery of its key's oldest rows that takes the row. A delivery takes at
    most `most` rows whose times lie within `seconds` of its first; deliveries of a key are counted along slots of that
    length since the key's first row, so each row's number follows from sums and no row is looked at one by one."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.min(order[0]).over(Window.partitionBy(key))
    slotted = rows.withColumn("slot", F.floor((F.col(order[0]) - first) / (seconds * 1e6)))
    in_slot = F.row_number().over(Window.partitionBy(key, "slot").orderBy(*order)) - 1
    opens = slotted.withColumn("opens", (in_slot % most == 0).cast("long"))
    return opens.select("*", (F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("flush")).drop("slot", "opens")


def once(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """At-least-once deliveries as exactly-once events, within the watermark."""
    return stream.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["id"])


def late_split(stream: DataFrame, now_us: int, late_seconds: int) -> DataFrame:
    """Late events keep their own time and are marked; they teach no state."""
    return stream.withColumn("late", F.lit(now_us) - F.col("us") > late_seconds * 1_000_000)
