"""Sequential features of each device's events, as windows over (device; captured_at, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A gap before the first event, or after a clock that went backwards.
UNKNOWN_GAP = 1e6


def ordered(key: str = "device") -> Window:
    return Window.partitionBy(key).orderBy("us", "id")


def seconds_since_previous() -> Column:
    return (F.col("us") - F.lag("us").over(ordered())) / 1e6


def quiet_gap() -> Column:
    """Seconds since the device's previous event; unknown ones are UNKNOWN_GAP."""
    gap = seconds_since_previous()
    return F.when(gap.isNull() | (gap < 0), UNKNOWN_GAP).otherwise(gap)


def with_burst_position(events: DataFrame, within: float = 60.0, most: int = 250) -> DataFrame:
    """quiet_gap and burst_pos: 0 after a gap of `within` seconds or more, else one more than the event before."""
    gapped = events.withColumn("quiet_gap", quiet_gap())
    islands = gapped.withColumn("island", F.sum((F.col("quiet_gap") >= within).cast("int")).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("device", "island").orderBy("us", "id")) - 1
    return islands.withColumn("burst_pos", F.least(place, F.lit(most))).drop("island")


def with_previous(frames: DataFrame, columns: list[str]) -> DataFrame:
    """prev: a struct of the previous frame's columns."""
    return frames.withColumn("prev", F.lag(F.struct(*columns)).over(ordered()))


def elapsed(backwards: float | None) -> Column:
    """Seconds since the previous frame: infinite for the first, and for a clock that went back too, or `backwards`."""
    gap = seconds_since_previous()
    return F.when(gap.isNull(), float("inf")).when(gap < 0, float("inf") if backwards is None else backwards).otherwise(gap)


def carried_forward(value: str, order: Window) -> Column:
    """The last known value up to this row."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def last_before(value: Column, order: Window) -> Column:
    """The last known value before this row."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
