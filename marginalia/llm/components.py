"""Components of the links within buckets, without listing the pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import connected_components
from . import common

#: Words of 64 bits in the sketch of a set that bounds the difference of two sets.
WORDS = 8
SKETCH = [f"p{j}" for j in range(WORDS)]


def own_elements(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, lone): how many ``elements`` (node, component, element) of each of ``nodes`` (node, component, size) no node of another component has.

    Elements, by far the most rows, are shuffled once.
    """
    by = Window.partitionBy("element")
    several = elements.withColumn("x", F.min("component").over(by)).withColumn("y", F.max("component").over(by)).where("x <> y")
    shared = several.groupBy("node").agg(F.count("*").alias("shared"))
    return nodes.join(shared, "node", "left").select("node", (F.col("size") - F.coalesce("shared", F.lit(0))).alias("lone"))


def plausible(differ: Column, num: int, den: int) -> Column:
    """Whether sets of ``size`` and ``size_1`` elements can link that differ in ``differ`` elements or more; unknown counts as yes."""
    fits = (den + num) * differ <= (den - num) * (F.col("size") + F.col("size_1"))
    return F.coalesce(fits & (den * F.least("size", "size_1") >= num * F.greatest("size", "size_1")), F.lit(True))


def apart() -> Column:
    """In how many groups of elements two sketches differ at least."""
    return sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_1"))) for p in SKETCH[1:]), F.bit_count(F.col("p0").bitwiseXOR(F.col("p0_1"))))


def bucket_components(buckets: DataFrame, light: DataFrame, links_of: Callable[[DataFrame], DataFrame], elements_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(node, component) of the nodes that linked pairs within buckets lead to.

    ``buckets`` (signature, node) holds the nodes that share a signature with others; ``light`` (node, size, p0 ...) the
    size and sketch of each node's set, null where a node stands for several sets; ``links_of`` keeps those of some pairs
    (a, b) that link, which is when their sets have num / den of all their elements in common; ``elements_of`` gives
    (node, component, element) of some ``nodes`` (node, component).

    Every node is compared with the first one of its bucket, which is then done. What is then in one component needs no further comparison,
    and what is in several is first looked at as a whole: elements that no other component has always differ, so a node
    with too many of them has no link left to find. Among the few that remain, rounds follow of 4, 256, 16,384 ... further
    pivots a bucket: one for each part that a hash deals its nodes to. A pivot meets the bucket's nodes of other
    components that its own elements and its sketch leave a link with, and is then done. Two sets that link differ in
    (sa + sb) * (den - num) / (den + num) elements at most, and a group of elements that is odd in one set and even in
    the other holds one that differs. In the end any two nodes of a bucket are in one component, were compared, or
    can't link.
    """
    other = light.select(*(F.col(c).alias(f"{c}_1") for c in light.columns))
    first = buckets.groupBy("signature").agg(F.min("node").alias("a"))
    rest = buckets.join(first, "signature").where("node <> a")
    pairs = common.materialize(rest.select("a", F.col("node").alias("b")).distinct(), "pairs")
    near = pairs.join(light, F.col("a") == F.col("node")).join(other, F.col("b") == F.col("node_1")).where(plausible(apart(), num, den)).select("a", "b")
    links = common.materialize(links_of(common.materialize(near, "near")).select("a", "b"), "links")
    components = connected_components(links)

    def labelled(rows: DataFrame) -> DataFrame:
        """``rows`` with their components, of buckets that hold several."""
        named = rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = named.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        return common.materialize(named.join(several.select("signature"), "signature", "left_semi"), "open")

    open_ = labelled(rest.select("signature", "node"))
    if open_.isEmpty():
        return components
    common.collect_garbage(buckets.sparkSession)
    nodes = common.materialize(open_.select("node", "component").distinct().join(light.select("node", "size"), "node"), "nodes")
    left = nodes.join(own_elements(elements_of(nodes), nodes), "node").where(f"lone IS NULL OR {num} * lone <= {den - num} * size").select("node", "lone")
    told = common.materialize(light.join(left, "node"), "told")
    rows, parts, tested = open_.select("signature", "node").join(told.select("node"), "node", "left_semi"), 4, None
    while True:
        open_ = labelled(rows)
        if open_.isEmpty():
            return components
        part = F.pmod(F.xxhash64(F.lit(parts), "node"), F.lit(parts))
        # What has the fewest elements of its own is near the middle of a group and links most of it.
        pivots = open_.join(told.select("node", "lone"), "node").groupBy("signature", part.alias("part")).agg(F.min(F.struct("lone", "node", "component")).alias("p"))
        pivots = common.materialize(pivots.select("signature", "p.node", "p.component"), "pivots")
        here, there = (x.join(told, "node") for x in (open_, pivots))
        there = there.select("signature", *(F.col(c).alias(f"{c}_1") for c in ("component", *told.columns)))
        met = here.join(there, "signature").where((F.col("component") != F.col("component_1")) & plausible(F.col("lone") + F.col("lone_1"), num, den) & plausible(apart(), num, den))
        pairs = met.select(F.least("node", "node_1").alias("a"), F.greatest("node", "node_1").alias("b")).distinct()
        pairs = common.materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = links.unionByName(common.materialize(links_of(pairs).select("a", "b"), "links"))
        components, parts = connected_components(links), parts * 64
        rows = open_.select("signature", "node").join(pivots, ["signature", "node"], "left_anti")
