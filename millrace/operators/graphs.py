"""Connected components of graphs whose edges lie in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import drop_staged, staged

#: Rounds that a graph may take; each halves distances to the root about, so this is beyond any table.
MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): the root is the smallest node that it can reach.

    In turn, each node hands its smallest neighbour to its greater ones, then to its smaller
    ones and itself, until the edges are stars. A round is two aggregations and two joins on
    the node; no list of neighbours is gathered.
    """
    loops = edges.where("a = b").select("a", "b")
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    for _ in range(MAX_ROUNDS):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        # Stars, and so done: no node has two edges down, or edges both down and up.
        ends = after.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(after.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        settled = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 AND down > 0").isEmpty()
        drop_staged(large)
        drop_staged(now)
        now = after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).unionByName(loops.select(F.col("a").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
