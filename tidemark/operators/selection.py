"""Exact percentiles, medians and deviations of groups of any size, by histograms that are refined in a few passes.

Each wanted rank has bounds between which its value lies, at first from a sketch. A pass counts the rows below and between
them; where more than MOST lie between, a histogram of these, with each bin's count, least and largest value, gives the
bin that holds the rank, and so the next bounds. The rows that are left are sorted. So no task holds more of a group than
BINS bins or MOST rows, however many distinct values it has, and results don't hang on the sketch: bounds that turn out
not to hold their rank are widened to all values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import scratch_path

#: Rows of a group that are sorted in one task at most, the sketch's accuracy (ranks off by a share of 1/ACCURACY) and bins.
MOST, ACCURACY, BINS = 50_000, 1000, 256
#: Targets that are broadcast; beyond, they meet the rows by a shuffled join.
BROADCAST_TARGETS = 100_000


def quantiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float], most: int = MOST, accuracy: int = ACCURACY) -> DataFrame:
    """(*keys, n, quantiles): for each group the count of its values and the array of its exact quantiles at `fractions`,
    interpolated linearly between neighbouring ranks. Null values don't count; a group without others has no row. Null keys
    make a group. The rows' keys and values are written once and scanned in each pass; values must be finite."""
    spark = rows.sparkSession
    path, count = scratch_path(spark, "selection"), iter(range(1 << 30))

    def saved(df: DataFrame) -> DataFrame:
        df.write.parquet(to := f"{path}/{next(count)}")
        return spark.read.schema(df.schema).parquet(to)

    names = [f"__k{i}" for i in range(len(keys))]
    own = saved(rows.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL"))
    by = [*names, "t"]
    # two neighbouring ranks for each fraction, with the sketch's bounds of both
    width = 2.0 / accuracy
    ends = [F.percentile_approx("v", F.lit(min(1.0, max(0.0, f + w))), accuracy) for f in fractions for w in (-width, width)]
    groups = own.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("top"), F.array(*ends).alias("ends"))
    places = [F.floor(F.lit(f) * (F.col("n") - 1)) for f in fractions]
    wanted = [F.struct(F.lit(2 * i + j).alias("t"), F.least(p + j, F.col("n") - 1).alias("rank"), F.col("ends")[2 * i].alias("low"), F.col("ends")[2 * i + 1].alias("high")) for i, p in enumerate(places) for j in (0, 1)]
    targets = saved(groups.select(*names, "n", "least", "top", F.inline(F.array(*wanted))))
    counts = _met(own, targets, names).groupBy(*by).agg(F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v").between(F.col("low"), F.col("high"))).alias("inside"))
    held = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside"))
    told = {"low": F.when(held, F.col("low")).otherwise(F.col("least")), "high": F.when(held, F.col("high")).otherwise(F.col("top")), "below": F.when(held, F.col("below")).otherwise(0), "inside": F.when(held, F.col("inside")).otherwise(F.col("n"))}
    targets = saved(_joined(targets, counts, by).select(*by, "n", "rank", *[c.alias(n) for n, c in told.items()]))
    while True:
        large = (F.col("inside") > most) & (F.col("low") < F.col("high"))
        if targets.where(large).isEmpty():
            break
        within = _met(own, targets.where(large), names).where(F.col("v").between(F.col("low"), F.col("high")))
        # halves, as the difference of two finite values may not be; the last bin takes the largest value
        bin_ = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        bins = within.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("size"), F.min("v").alias("least"), F.max("v").alias("top"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = _joined(targets.where(large), bins.select("*", before.alias("before")), by)
        chosen = met.where((F.col("below") + F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("size")))
        closer = chosen.select(*by, "n", "rank", F.col("least").alias("low"), F.col("top").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("size").alias("inside"))
        targets = saved(targets.where(~large).unionByName(closer))
    few = _met(own, targets.where("low < high"), names).where(F.col("v").between(F.col("low"), F.col("high"))).groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("few"))
    renamed = few.withColumnsRenamed({c: f"{c}_" for c in by})
    found = targets.join(renamed, _same(by), "left").select(*by, "n", F.coalesce(F.get("few", (F.col("rank") - F.col("below")).cast("int")), "low").alias("v"))
    values = found.groupBy(*names, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("v"))
    out = []
    for i, f in enumerate(fractions):
        part = f * (F.col("n") - 1) - F.floor(F.lit(f) * (F.col("n") - 1))
        out.append(F.when(part == 0, F.col("v")[2 * i]).otherwise((1 - part) * F.col("v")[2 * i] + part * F.col("v")[2 * i + 1]))
    return values.select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], "n", F.array(*out).alias("quantiles"))


def _same(names: list[str]):
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], F.lit(True))


def _joined(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    return left.join(right.withColumnsRenamed({n: f"{n}_" for n in names}), _same(names)).drop(*[f"{n}_" for n in names])


def _met(own: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """Each row with each target of its group."""
    few = targets.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
    return _joined(own, F.broadcast(targets) if few else targets, names)


def median_and_deviation(rows: DataFrame, keys: list[str], value: str, scale: float = 1.4826, most: int = MOST) -> DataFrame:
    """(*keys, median, mad): each group's median and the scaled median of its values' distances from it."""
    medians = quantiles(rows, keys, value, [0.5], most).select(*keys, F.col("quantiles")[0].alias("median"))
    few = medians.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
    far = _joined(rows, F.broadcast(medians) if few else medians, keys).withColumn("__far", F.abs(F.col(value).cast("double") - F.col("median")))
    spread = quantiles(far, [*keys, "median"], "__far", [0.5], most)
    return spread.select(*keys, "median", (F.col("quantiles")[0] * scale).alias("mad"))
