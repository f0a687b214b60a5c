"""Connected components by alternating large-star and small-star steps, as joins of edge tables.

Each step sends every edge to the smallest neighbour, so hubs are joined (and split by the engine's skew handling), never
gathered into one row. The edges stay in the shared folder between steps; only a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored



def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is its smallest reachable node.

    Edges from a node to itself and null ends are ignored; an empty table gives an empty result.
    """
    # Kept as (hi, lo) with hi > lo.
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while True:
        # Large star: every neighbour above a node goes to the smallest of the node's neighbours and itself.
        both = now.select(F.col("hi").alias("v"), F.col("lo").alias("w")).union(now.select(F.col("lo").alias("v"), F.col("hi").alias("w")))
        least = both.groupBy(F.col("v").alias("m_of")).agg(F.min("w").alias("m"))
        large = now.join(least, F.col("lo") == F.col("m_of")).select("hi", F.least("lo", "m").alias("lo")).distinct()
        # Small star: a node's lower neighbours, and itself, go to the smallest of them.
        low = large.groupBy(F.col("hi").alias("m_of")).agg(F.min("lo").alias("m"))
        small = large.join(low, F.col("hi") == F.col("m_of")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").union(low.select(F.col("m_of").alias("hi"), F.col("m").alias("lo")))
        after = stored(small.distinct(), "edges")
        # Done when no node has an edge down and an edge up, and none has two down: a forest of stars.
        ups = after.select(F.col("lo").alias("u")).distinct()
        chained = after.join(ups, F.col("hi") == F.col("u"), "left_semi").limit(1).count()
        several = 0 if chained else after.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        now = after
        if not chained and not several:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
