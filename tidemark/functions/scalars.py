"""Scalar functions that Spark has no builtin for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_time(literal: Column, now: Column) -> Column:
    """Epoch seconds of `now`, `-Nh`, `-Nd` or a timestamp; null if it is none of them."""
    n = F.regexp_extract(literal, r"^-(\d+)[hd]$", 1).try_cast("long")
    unit = F.when(literal.endswith("h"), 3600).when(literal.endswith("d"), 86400)
    return F.when(literal == "now", now).when(n.isNotNull(), now - n * unit).otherwise(F.unix_seconds(F.try_to_timestamp(literal)))


def human_time(seconds: Column) -> Column:
    part = lambda n, per: F.floor(n / per).cast("string")
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(part(seconds, 60), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
        .when(seconds < 86400, F.concat(part(seconds, 3600), F.lit("h "), part(seconds % 3600, 60), F.lit("m")))
        .otherwise(F.concat(part(seconds, 86400), F.lit("d "), part(seconds % 86400, 3600), F.lit("h")))
    )


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII string."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    codes = F.filter(codes, lambda c: c > 0)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def stamp_in_name(name: Column) -> Column:
    """The timestamp in a file name (20YYMMDD_HHMMSS), null if there is none or it is no time."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(20\d{6}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def escape_html(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text
