"""Connected components of a bipartite graph, by hash-to-min over shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantora.session import cut_lineage

#: Rounds after which the graph is taken for broken; each round halves path lengths or better.
ROUNDS = 40


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node and component (the smallest node of it) of every node of the edges.

    Every round gives both ends of each edge the smaller of their labels and then lets
    each node jump to its label's label; labels only fall, and the loop ends when none
    does. Label tables are aggregates keyed by node, so hot nodes are combined before
    the shuffle, and nothing but a count reaches the driver.
    """
    pairs = edges.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).filter("a is not null and b is not null").distinct()
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"))
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = lower.join(labels.select(F.col("node").alias("c"), F.col("c").alias("up")), "c", "left")
        after = cut_lineage(jump.select("node", "old", F.least("c", F.coalesce("up", "c")).alias("c")))
        labels = after.select("node", "c")
        if after.filter("old <> c").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return labels.withColumnRenamed("c", "component")
