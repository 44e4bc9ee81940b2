"""Connected components by alternating large-star and small-star rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.operators.checkpoints import cut


#: Edges that one task writes between rounds, as far as they were so many in the first one.
TASK_ROWS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) of every node in edges (a long, b long); nulls and loops don't count.

    A round links each node's neighbours to the smallest of them (larger ones, then smaller ones), with pre-aggregated minima and joins
    on single nodes, so a hub's edges can be split among tasks. Rounds go on until nothing changes: about the logarithm of
    the longest path. Each round is checkpointed.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, rows = None, now.count()
    while True:
        # Large star: of u's neighbours, those above u are linked to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select("a", "m")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star: u and its smaller neighbours are linked to the smallest of those.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small.coalesce(max(1, -(-rows // TASK_ROWS))))  # few edges: few tasks and files
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
