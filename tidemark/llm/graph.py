"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b), component being the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges stand still. Each step is an
    aggregate with map-side combining and a join on the node. The aggregates are written to the shared folder before they
    are joined, so both sides of the join come from a plain shuffle and a hub's rows can be split over tasks. Null ends and self loops carry no link and are left out;
    an empty input gives an empty result.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")))
        large = scratch.save(both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = scratch.save(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        new = scratch.save(large.join(down, F.col("a") == F.col("n")).select(F.inline(ends)).where("a <> b").distinct())
        scratch.drop(now, least, large, down)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge (a, b) at most, to a node that has none: the edges are the components."""
    at = edges.select(F.col("a").alias("n"), F.lit(1).alias("down")).union(edges.select(F.col("b").alias("n"), F.lit(0).alias("down")).distinct())
    return at.groupBy("n").agg(F.sum("down").alias("down"), F.count("*").alias("all")).where("down > 1 OR (down = 1 AND all > 1)").isEmpty()


def joined_components(component: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components (node, component) that further links (a, b) leave of given ones: the components of the graph whose
    nodes are the given ones' smallest nodes, so its size follows the new links alone. Nodes may be new."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        named = component.select(F.col("node").alias("n"), F.col("component").alias("c"))
        ends = ends.join(named, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("c", end)).select("a", "b")
    found = scratch.save(connected_components(ends, scratch))
    moved = found.select(F.col("node").alias("n"), F.col("component").alias("c"))
    known = component.join(moved, F.col("component") == F.col("n"), "left").select("node", F.coalesce("c", "component").alias("component"))
    return scratch.save(known.union(found.join(component.select("node"), "node", "left_anti")))
