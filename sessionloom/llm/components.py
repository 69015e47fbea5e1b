"""Connected components by alternating large-star and small-star steps.

Each step groups the edges by a node with a map-side minimum and joins that
minimum back. The join sorts the edges of a node with very many neighbours, 16
bytes each, without holding them, and adaptive execution splits it once it is
skewed; no list of neighbours is ever made.
Edges between the steps are tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a lesser neighbour has one only, which has none itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) pairs -> (u, v): every node but a component's least, and that least node.

    Self-loops, repeated and reversed pairs are allowed; an empty input gives
    an empty result. Nodes of any orderable type serve.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        # The large star's result is read by the small star twice, so it is a table too.
        large = scratch.save(_large_star(now), "large")
        new = scratch.save(_small_star(large), "small")
        scratch.drop(now, large)
        now = new
    return now
