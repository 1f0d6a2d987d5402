"""Time buckets without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import carried_forward

THREE_HOURS = 3 * 3600


def bucket(us: Column, seconds: int = THREE_HOURS) -> Column:
    """The epoch second at which the tumbling bucket begins."""
    return F.floor(us / (seconds * 1_000_000)) * seconds


def spine(spark, first: int, last: int, seconds: int = THREE_HOURS) -> DataFrame:
    """All bucket beginnings from first to last, both included."""
    return spark.range(first, last + 1, seconds).select(F.col("id").alias("bucket"))


def filled(buckets: DataFrame, value: str) -> DataFrame:
    """value carried forward into empty buckets, estimated telling which; empty buckets before the first value go. One
    window over one row for each bucket: the rows follow the time span, not the events."""
    w = Window.orderBy("bucket")
    return buckets.withColumn("estimated", F.col(value).isNull()).withColumn(value, carried_forward(value, w)).where(F.col(value).isNotNull())
