"""Operations on schema-less documents: merge, tolerant comparison, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; the second wins."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)


def mismatch(kind: Column, expected: Column, actual: Column, tolerance: Column) -> Column:
    """Whether two texts differ under a check's type; null where one of them is missing, which is no verdict."""
    number = lambda c: c.try_cast("double")
    tol = F.coalesce(tolerance, F.when(kind == "float", 0.5).otherwise(0.0))
    by_kind = F.when(kind == "exact", expected != actual).when(kind.isin("int", "float"), F.abs(number(expected) - number(actual)) > tol)
    by_kind = by_kind.when(kind == "bool", F.lower(expected).try_cast("boolean") != F.lower(actual).try_cast("boolean"))
    return F.when(expected.isNotNull() & actual.isNotNull(), by_kind)


#: Checks that are sent to every frame; longer lists meet the frames' own entries by a shuffled join.
MOST_CHECKS = 1000


def parity(frames: DataFrame, checks: DataFrame, expected: str, actual: str) -> DataFrame:
    """Every frame's maps against every check (name, kind, tolerance), where both maps have the name; a list of up to
    MOST_CHECKS, counted first, is broadcast."""
    check = checks.select(F.struct("name", "kind", F.col("tolerance").cast("double").alias("tolerance")).alias("check"))
    if checks.limit(MOST_CHECKS + 1).count() <= MOST_CHECKS:
        out = frames.crossJoin(F.broadcast(check))
    else:
        out = frames.withColumn("__name", F.explode(F.map_keys(expected))).join(check, F.col("__name") == F.col("check.name")).drop("__name")
    e, a = F.try_element_at(expected, F.col("check.name")), F.try_element_at(actual, F.col("check.name"))
    return out.withColumn("mismatch", mismatch(F.col("check.kind"), e, a, F.col("check.tolerance"))).where("mismatch is not null")


def rendered(document: Column, spec: list[dict]) -> Column:
    """Entries (key, text, style) of a map of texts by display rules: hidden values go, a value under warn_below warns,
    badges take a palette's colour or `grey`; listed keys first, in the rules' order, then the others."""
    listed = F.array(*[F.lit(r["key"]) for r in spec])

    def entry(key: Column, value: Column, rule: dict | None) -> Column:
        style = F.lit("plain")
        if rule and "palette" in rule:
            style = F.lit("grey")
            for name, colour in rule["palette"].items():
                style = F.when(value == name, colour).otherwise(style)
        if rule and "warn_below" in rule:
            style = F.when(value.try_cast("double") < rule["warn_below"], "warn").otherwise("plain")
        return F.struct(key.alias("key"), value.alias("text"), style.alias("style"))

    parts = []
    for r in spec:
        value = F.try_element_at(document, F.lit(r["key"]))
        shown = value.isNotNull()
        for hidden in r.get("hide", ()):
            shown = shown & (value != hidden)
        parts.append(F.when(shown, F.array(entry(F.lit(r["key"]), value, r))).otherwise(F.array().cast("array<struct<key:string,text:string,style:string>>")))
    rest = F.filter(F.map_entries(document), lambda e: ~F.array_contains(listed, e["key"]))
    parts.append(F.array_sort(F.transform(rest, lambda e: entry(e["key"], e["value"], None))))
    return F.concat(*parts)
