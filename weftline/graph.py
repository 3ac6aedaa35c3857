"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternates large-star and small-star rounds. Each round is two aggregations
    that combine before they shuffle and two joins on the node, and its result is
    written to the shared folder, where it takes the place of the round before. It
    ends when every node but the roots has one edge, to a root. Rounds grow with the
    logarithm of the graph's size, and no node's neighbours are ever gathered in one
    row. Null ends and loops link nothing; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(e.where("u is not null and v is not null and u <> v").distinct())
    while _unsettled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _unsettled(e: DataFrame) -> bool:
    """Whether a node has two edges to smaller ones, or one while it is itself the
    smaller end of another: what stars do not have."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    held = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not held.where("below > 1 or below = 1 and above = 1").isEmpty()
