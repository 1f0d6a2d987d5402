"""Joins by time and by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, carry: list[str], least: int) -> DataFrame:
    """Each left row with the latest right row of its key that is at least `least` before it (in the units of `at`).

    One sort by key and time over the union of both sides, no range join: right rows are moved `least` later and come
    before left rows of the same time."""
    l_side = left.select(F.lit(1).alias("__side"), F.col(key), F.col(at).alias("__at"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*carry).alias("x")).schema[0].dataType).alias("__found"))
    r_side = right.select(F.lit(0).alias("__side"), F.col(key), (F.col(at) + least).alias("__at"), F.lit(None).cast(l_side.schema["__row"].dataType).alias("__row"), F.struct(*carry).alias("__found"))
    w = Window.partitionBy(key).orderBy("__at", "__side", *[F.col(f"__found.{c}") for c in carry]).rowsBetween(Window.unboundedPreceding, 0)
    both = l_side.union(r_side).withColumn("__found", F.last("__found", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__row.*", F.col("__found").alias("found"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of one length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(rows: DataFrame, models: DataFrame, vector: str, model_vector: str, model_key: str, digits: int | None = None) -> DataFrame:
    """Each row with the nearest of a bounded set of models (at most 1000 rows; more raise an error), the smaller key on
    ties: the models become one constant array, so no row is shuffled or copied. digits: distances are rounded to so many
    places before they are compared."""
    held = models.select(F.col(model_key).alias("k"), F.col(model_vector).alias("v")).orderBy("k").limit(1001).collect()
    if len(held) > 1000:
        raise ValueError("more than 1000 models")
    kinds = models.schema[model_key].dataType.simpleString()
    table = F.array(*[F.struct(F.lit(m.k).cast(kinds).alias("k"), F.array(*[F.lit(float(x)) for x in m.v]).alias("v")) for m in held])
    apart = lambda v: distance(F.col(vector), v) if digits is None else F.round(distance(F.col(vector), v), digits)
    scored = F.transform(table, lambda m: F.struct(apart(m["v"]).alias("d"), m["k"].alias("k")))
    return rows.withColumn("nearest", F.array_min(scored))
