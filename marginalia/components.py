"""Connected components by DataFrame joins: large and small stars until every component is one star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected_components(edges: DataFrame, kind: str = "long") -> DataFrame:
    """(node, component): the smallest node that ``edges`` (a, b) lead to. Nodes without an edge are absent.

    Union-find by large and small stars: every node ties its larger neighbours to its smallest one, then the smaller ones,
    until each component is one star. The edge count never grows, minima are taken before the shuffle, and the joins
    go by key, so a hub is split by the adaptive skew join. Every round is written to the shared folder, and the one
    before it is deleted.
    """
    a, b = F.col("a").cast(kind), F.col("b").cast(kind)
    stars = scratch.materialize(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while not _all_stars(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: larger neighbours of a node go to the least of its neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star: a node and its smaller neighbours go to the least of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b")))
        before, stars = stars, scratch.materialize(small.where("a <> b").distinct(), "stars")
        scratch.discard(before)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def dense_components(edges: DataFrame, kind: str = "long") -> DataFrame:
    """The same for far more ``edges`` than nodes: the rounds go over the edge of each node to its smallest neighbour, then over those that still lie
    between two of the components found; all edges are read for these two steps only."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    least = edges.select(ends).groupBy("e.a").agg(F.min("e.b").alias("b"))
    found = scratch.materialize(connected_components(least, kind), "components")
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    rest = edges.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    joined = connected_components(rest, kind).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return found.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node (a) has one smaller neighbour (b), which has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.lit(None).cast(edges.schema["b"].dataType).alias("to")))).alias("e"))
    seen = ends.select("e.node", "e.to").groupBy("node").agg(F.min("to").alias("x"), F.max("to").alias("y"), F.count_if(F.col("to").isNull()).alias("centre"))
    return seen.where("x <> y OR (x IS NOT NULL AND centre > 0)").isEmpty()
