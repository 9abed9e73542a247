"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps are a minimum per node and a join, so no node's neighbours are ever gathered in one place. Each round is written to the shared
folder; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b): node and root, the smallest node that it reaches. Roots themselves have no row.

    Edges may be repeated, reversed or loops; without edges there are no rows. The table that holds the result is left to the caller.
    """
    own = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = written(own, "edges")
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, state = state, written(small, "edges")
        discard(before)
        # done when every node is a root or has one edge, to a root
        ends = state.select(F.col("a").alias("node"), F.lit(1).alias("leaf")).unionByName(state.select(F.col("b").alias("node"), F.lit(0).alias("leaf")))
        roles = ends.groupBy("node").agg(F.sum("leaf").alias("edges"), F.min("leaf").alias("least"))
        if not roles.where("edges > 1 OR (edges = 1 AND least = 0)").take(1):
            roots = state.withColumnsRenamed({"a": "node", "b": "root"})
            roots.written_to = state.written_to
            return roots
