"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node reachable.

    Alternating large-star and small-star contraction: each round links neighbours to local minima by
    minimum aggregates (partial sums first) and joins, and writes the new edges to the shared folder. Rounds
    grow with the logarithm of the components' size. A node's minimum is written before it is joined back to the
    node's edges, so that adaptive execution can split the node that a large component's edges all lead to.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now = materialize(now, "edges")
    while True:
        both = now.union(now.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        # Large star: every larger neighbour of u is linked to the least node around u, itself included.
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
        starred = materialize(large.select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # Small star: u and its smaller neighbours are linked to the least of them.
        down = materialize(starred.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = starred.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # Done when every edge leads to a root: no target is itself a source, and each source has one target.
        left = after.groupBy("u").count().filter("count > 1").select("u").union(after.join(after.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").select("u")).limit(1).count()
        for done in (now, starred, least, down):
            discard(done)
        now = after
        if not left:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
