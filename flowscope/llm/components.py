"""Connected components of a graph too large for one machine, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Each round every node points its larger neighbours (large star), then all its smaller ones (small star), to the
    smallest it knows.  Rounds grow with the logarithm of the longest path; each one is written to the shared folder.
    A node with many links costs one aggregate and one join that adaptive execution can split.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialize(edges, "components")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        following = materialize(small.where("u > v").distinct(), "components")
        # both sides are free of repeats: equal counts and no row of one missing in the other mean a fixed point
        if not following.exceptAll(edges).limit(1).count() and following.count() == edges.count():
            break
        edges = following
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v"), F.col("v")).distinct())
