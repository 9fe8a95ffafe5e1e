"""Connected components of an edge table, without any part of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u long, v long); root is the smallest node reachable.

    Alternating large-star and small-star rounds: each rewires neighbours to the smallest node they know. A node's
    smallest neighbour is found by a min aggregate (combined before the shuffle), written, and joined back, so a node with very
    many neighbours is never gathered in one task. Each round's edges are written to the shared folder. Loops and
    repeated edges are fine; edges with a null end count for nothing. An empty table gives no rows.
    """
    plain = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, state = written(plain, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, both.where("v > u")), "edges")
        small = written(_small_star(large), "edges")
        now = small.agg(F.count("*"), F.coalesce(F.sum(F.crc32(F.concat_ws(",", "u", "v"))), F.lit(0))).first()
        edges = small
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select("v", "v")).distinct()


def _star(neighbours: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges from each moved neighbour v of u to the smallest of u and its neighbours."""
    least = written(neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of those."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).where("u > v").distinct()
