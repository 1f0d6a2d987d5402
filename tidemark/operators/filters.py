"""Predicates of the gallery: which sources and labels are shown."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = ("pir", "rtc")
LABELS = ("bird", "ignore", "special")


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts) if parts else F.lit(False)


def selected(text: str | None, known: Iterable[str]) -> set[str]:
    """The members of a comma-separated parameter that are known; all of them if there is no parameter."""
    return set(known) if text is None else {x.strip() for x in text.split(",")} & set(known)


def source_filter(active: set[str]) -> Column:
    """A missing source counts as pir. Both: no predicate; none: nothing."""
    if active >= set(SOURCES):
        return F.lit(True)
    parts = [(F.col("source") == "pir") | F.col("source").isNull()] if "pir" in active else []
    return any_of(parts + ([F.col("source") == "rtc"] if "rtc" in active else []))


def label_filter(active: set[str], batched: bool = True) -> Column:
    """cloud, batched and none by result, the others by label. none: no label and a known result that is neither clouds
    nor batched; a missing result is in no option. Without `batched` (the detail page) none keeps batched frames."""
    options = {"cloud", "none", *LABELS, *(["batched"] if batched else [])}
    if active >= options:
        return F.lit(True)
    result, label = F.col("result"), F.col("label")
    parts = [label == x for x in LABELS if x in active]
    if "cloud" in active:
        parts.append(result == "clouds")
    if batched and "batched" in active:
        parts.append(result == "batched")
    if "none" in active:
        none = label.isNull() & (result != "clouds")
        parts.append(none & (result != "batched") if batched else none)
    return any_of(parts)


def updates_model(result: Column, stage: Column, source: Column) -> Column:
    """Timer frames teach the background model if their stage is WARMUP or NIGHT or they are clouds."""
    return (source == "rtc") & (stage.isin("WARMUP", "NIGHT") | (result == "clouds"))
