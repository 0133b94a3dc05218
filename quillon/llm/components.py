"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import materialize, scratch


#: While there are no more edges than this, each node's minimum is sent to all tasks (16 bytes a node).
BROADCAST_EDGES = 400_000


def _smallest_neighbour(pairs: DataFrame, few: bool) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and all its v. The minimum is combined before the shuffle; with
    ``few`` edges it comes back as a broadcast, so that the edges of a hub never meet in one task."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(F.broadcast(least) if few else least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (columns a, b: long); component is the smallest node.

    Each round points every node's larger neighbours at its smallest one, then its smaller neighbours; after
    O(log n) rounds only stars remain. Hubs are safe: the minimum is a combinable aggregate and the join back
    can be split by the adaptive planner. An empty edge table gives an empty result; null ends are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null").distinct()
    spark = edges.sparkSession
    edges = materialize(edges, "edges")
    before, n = None, edges.count()
    while True:
        with scratch(spark) as keep:
            edges = _round(edges, n <= BROADCAST_EDGES)
            keep(edges)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before, n = now, now[0]
    stars = edges.where("u <> v")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def _round(edges: DataFrame, few: bool) -> DataFrame:
    """Larger neighbours to the smallest one, then smaller ones and the node itself to the smallest of them."""
    proper = edges.where("u <> v")
    mirrored = proper.select("u", "v").unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _smallest_neighbour(mirrored, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _smallest_neighbour(large, few)
    found = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
    return materialize(found.distinct(), "edges")
