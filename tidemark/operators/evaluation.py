"""Evaluation: confusion counts, curves, ranks and percentiles, without pairing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def confusion(truth: Column, predicted: Column, negative: str) -> list[Column]:
    """tp, fn, tn, fp, accuracy and the recalls of both classes; `negative` names the class that may be suppressed."""
    t, p = truth != negative, predicted != negative
    tp, fn, tn, fp = F.count_if(t & p), F.count_if(t & ~p), F.count_if(~t & ~p), F.count_if(~t & p)
    return [tp.alias("tp"), fn.alias("fn"), tn.alias("tn"), fp.alias("fp"), F.round(ratio(tp + tn, tp + fn + tn + fp), 6).alias("accuracy"), F.round(ratio(tp, tp + fn), 6).alias("process_recall"), F.round(ratio(tn, tn + fp), 6).alias("clouds_recall")]


#: Ranges of values that running sums are taken over apart.
PIECES = 64


def running_sums(rows: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """`rows` with before_<s>, the sum of s over all rows before (0 for the first), and all_<s>, over all rows, by an order
    without ties. Two levels: quantiles cut the values into ranges, sums within a range are a window of its own, and those of
    the ranges before come from a table of PIECES rows; so no task takes all rows. Null values come first."""
    bounds = sorted({x for x in rows.approxQuantile(order, [k / PIECES for k in range(1, PIECES)], 0.01)}) if dict(rows.dtypes)[order] != "string" else []
    piece = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    cut = rows.withColumn("__piece", piece)
    totals = cut.groupBy("__piece").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    over, every = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("__piece", *[F.coalesce(F.sum(f"__{s}").over(over), F.lit(0)).alias(f"__base_{s}") for s in sums], *[F.sum(f"__{s}").over(every).alias(f"all_{s}") for s in sums])
    inside = Window.partitionBy("__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(F.broadcast(bases), "__piece")
    before = [(F.col(f"__base_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in sums]
    return joined.select(*rows.columns, *before, *[f"all_{s}" for s in sums])


def suppression_curve(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """(cut, fraction, lost) for each distinct score: the share of rows below it, and the positives among them; and a last
    cut, null, that takes all. Scores are grouped first, so the running sum goes over distinct scores alone."""
    by = scored.groupBy(F.col(score).alias("cut")).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("k"))
    cuts = running_sums(by, "cut", ["n", "k"]).select("cut", (F.col("before_n") / F.col("all_n")).alias("fraction"), F.col("before_k").alias("lost"))
    return cuts.union(scored.agg(F.lit(None).cast(scored.schema[score].dataType).alias("cut"), F.lit(1.0).alias("fraction"), F.sum(F.col(positive).cast("long")).alias("lost")))


def auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: P(positive above negative) + P(tie) / 2 by rank sums over distinct scores; NaN if a class is empty."""
    by = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    wins = running_sums(by, "s", ["n"]).select("p", "n", (F.col("p") * (F.col("before_n") + F.col("n") / 2)).alias("w"))
    pairs = F.sum("p") * F.sum("n")
    return wins.agg(F.when(pairs > 0, F.sum("w") / pairs).otherwise(F.lit(float("nan"))).alias("auc"))


def quantised(score: Column, top: int = 255) -> Column:
    """Dense ranks spread over 0 to `top`, rounded half to even. One window over all rows: for score tables."""
    rank = F.dense_rank().over(Window.orderBy(score)) - 1
    most = F.max("__rank").over(Window.partitionBy())
    return rank, F.bround(F.col("__rank") * top / F.greatest(most, F.lit(1))).cast("int")
