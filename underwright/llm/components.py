"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.llm.common import stored


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest node near it: the larger neighbours, or the smaller ones and itself.

    The smallest neighbour is an aggregate with partial sums and is joined back, so no node's neighbours are gathered.
    """
    pairs = both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = pairs.join(least, "a")
    linked = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the smallest node of its component.

    Ends when a round changes nothing; the number of rounds grows with the logarithm of the diameter. Self-links are ignored.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        edges = stored(star(star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
