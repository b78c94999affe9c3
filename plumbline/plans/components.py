"""Connected components by label exchange with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import cut


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v) and (a, b) -> (v, component): the smallest vertex reachable from v.

    Each round takes the smallest label among the neighbours and then follows the label
    of that label, so the rounds grow with the logarithm of the longest path. Every round
    is checkpointed, which keeps the plan short and survives lost executors.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(vertices.select("v", F.col("v").alias("l")))
    while True:   # labels only fall, so a round without a change comes
        near = (both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("l").alias("m")))
        lower = labels.join(near, labels["v"] == near["a"], "left").select(
            "v", "l", F.least("l", F.coalesce("m", "l")).alias("n"))
        known = lower.select(F.col("v").alias("_v"), F.col("n").alias("_n"))
        stepped = cut(lower.join(known, lower["n"] == known["_v"]).select("v", "l", F.col("_n").alias("n")))
        changed = not stepped.where(F.col("n") != F.col("l")).isEmpty()
        labels = stepped.select("v", F.col("n").alias("l"))
        if not changed:
            return labels.withColumnRenamed("l", "component")
