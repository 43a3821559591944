"""Connected components by alternating large-star and small-star steps; edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.scale import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large: a node's larger neighbours join its least; small: its smaller ones and itself do.

    The least neighbours are stored first: a hub's edges then meet one stored row, broadcast by Spark where its files are small
    and else in a join that splits skewed keys.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    j = both.join(least, "u")
    up = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return (up if large else down).where("u <> v").distinct()


def _unsettled(edges: DataFrame) -> bool:
    """True if a node has two smaller neighbours, or one and a larger one: else every component is a star around its least."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) of every node of ``pairs`` (a, b): the label is the least node of the component."""
    edges = stash(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while _unsettled(edges):
        edges = stash(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
