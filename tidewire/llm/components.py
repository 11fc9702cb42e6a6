"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to
    the least of its neighbourhood; after about log n rounds every node hangs
    on its root.  A node's least neighbour is a partial aggregate, and the join
    that follows can be split by AQE at hot nodes.  Rounds are cut by scratch
    tables.  Null ends and loops are left out.
    """
    pair = F.array_sort(F.array("u", "v"))
    edges = materialize(edges.filter("u <> v").select(pair[0].alias("v"), pair[1].alias("u")).distinct(), "star-edges")
    state = None
    while True:
        # Large star: neighbours above the node hang on the least of its neighbourhood.
        around = _both_ways(edges)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: the node and its smaller neighbours hang on the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialize(linked.union(least.select("u", F.col("m").alias("v"))).distinct(), "star-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.min(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    own = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    roots = own.select(F.col("root").alias("node"), "root").distinct()
    return own.union(roots)
