"""Lineage as a table of nodes and a table of edges (source, target, relationship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import cut


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Direct predecessors of the given nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(
        F.col("target").alias("id"), F.col("source").alias("dependency"), "relationship")


def dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Direct successors of the given nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").select(
        F.col("source").alias("id"), F.col("target").alias("dependent"), "relationship")


def _second_hop(steps: DataFrame) -> DataFrame:
    """(a, b, out_a, out_b, ways_b) distinct steps -> (id, n): distinct nodes two steps away.

    Where a node takes a single step, its second hop is all that the next node steps to;
    and a node with one way in is reached only once. Both are counted by sums. Pairs are
    listed only for nodes with several steps, and only to nodes with several ways in.
    """
    single = steps.where("out_a = 1 AND out_b > 0").select(F.col("a").alias("id"), F.col("out_b").alias("n"))
    several = steps.where("out_a > 1 AND out_b > 0").select("a", "b")
    once = steps.where("ways_b = 1").groupBy(F.col("a").alias("b")).agg(F.count("*").alias("n"))
    sure = several.join(once, "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    shared = steps.where("ways_b > 1").select(F.col("a").alias("b"), F.col("b").alias("c"))
    listed = several.join(shared, "b").select(F.col("a").alias("id"), "c").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return single.unionByName(sure).unionByName(listed).groupBy("id").agg(F.sum("n").alias("n"))


def impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependents and dependencies at one and two steps for every node.

    The impact count adds both steps, so a node seen at both counts twice.
    """
    step = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    # one table of ways out and in serves both directions: the fan-out of one is the fan-in of the other
    ends = step.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("ways")).unionByName(
        step.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("ways")))
    degree = cut(ends.groupBy("id").agg(F.sum("out").alias("out"), F.sum("ways").alias("ways")))

    def at(c: str) -> DataFrame:
        return degree.select(F.col("id").alias(c), F.col("out").alias(f"out_{c}"), F.col("ways").alias(f"ways_{c}"))

    forward = cut(step.join(at("a"), "a").join(at("b"), "b"))
    backward = forward.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ways_b").alias("out_a"), F.col("ways_a").alias("out_b"),
                              F.col("out_a").alias("ways_b"))
    parts = [degree.select("id", F.col("out").alias("n"), F.lit("direct_dependents").alias("what")),
             degree.select("id", F.col("ways").alias("n"), F.lit("direct_dependencies").alias("what")),
             _second_hop(forward).withColumn("what", F.lit("indirect_dependents")),
             _second_hop(backward).withColumn("what", F.lit("indirect_dependencies"))]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    names = ["direct_dependents", "indirect_dependents", "direct_dependencies", "indirect_dependencies"]
    wide = long.groupBy("id").agg(*[F.sum(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])
    out = nodes.select("id").join(wide, "id", "left").fillna(0, names)
    count = F.col("direct_dependents") + F.col("indirect_dependents")
    return out.withColumn("impact_count", count).withColumn(
        "severity", F.when(count >= 5, "high").when(count >= 2, "medium").otherwise("low"))


def reach(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, id, depth): nodes reached along successors within ``depth`` steps.

    Every step joins the new nodes only; the visited ones are kept out by an anti join.
    """
    frontier = roots.select(F.col("id").alias("root"), "id")
    seen = frontier.withColumn("depth", F.lit(0))
    steps = edges.select("source", "target")
    for d in range(1, depth + 1):
        reached = frontier.join(steps, F.col("id") == F.col("source")).select("root", F.col("target").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("root", "id"), ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    return seen


def walked_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges leaving the reached nodes, except those back to a node visited before.

    Nodes of one depth are visited in the order of their ids.
    """
    here = reached.select("root", F.col("id").alias("source"), F.col("depth").alias("_d"))
    there = reached.select("root", F.col("id").alias("target"), F.col("depth").alias("_e"))
    before = (F.col("_e") < F.col("_d")) | ((F.col("_e") == F.col("_d")) & (F.col("target") <= F.col("source")))
    return (edges.join(here, "source").join(there, ["root", "target"], "left")
            .where(F.col("_e").isNull() | ~before).select("root", "source", "target", "relationship"))


def overview(nodes: DataFrame, edges: DataFrame, parent_type: str) -> DataFrame:
    """(section, name, n): nodes by type, and children of the parent type by relationship."""
    types = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("section", F.lit("type"))
    parents = nodes.where(F.col("type") == parent_type).select(F.col("id").alias("source"))
    children = edges.join(parents, "source", "left_semi").groupBy(
        F.concat_ws("/", "source", "relationship").alias("name")).agg(F.count("*").alias("n")).withColumn("section", F.lit("children"))
    return types.unionByName(children).select("section", "name", "n")


def timeline(nodes: DataFrame, edges: DataFrame, name: str, dataset_type: str = "dataset") -> DataFrame:
    """Versions and events of one dataset in time order.

    Bad or missing timestamps come first, a version before its events at the same time.
    """
    versions = nodes.where((F.col("type") == dataset_type) & (F.col("name") == name))
    own = versions.select(F.lit("version").alias("event_type"), "id", F.col("id").alias("dataset_id"), "version", "timestamp")
    after = versions.select(F.col("id").alias("source"), "version")
    events = (edges.join(after, "source").join(nodes.select(F.col("id").alias("target"), "type", "timestamp"), "target")
              .select(F.col("type").alias("event_type"), F.col("target").alias("id"), F.col("source").alias("dataset_id"),
                      "version", "timestamp"))
    both = own.unionByName(events).withColumn("_at", F.try_to_timestamp("timestamp"))
    return both.orderBy(F.asc_nulls_first("_at"), F.when(F.col("event_type") == "version", 0).otherwise(1), "id").drop("_at")


def version_items(nodes: DataFrame, edges: DataFrame, name: str, version: str) -> DataFrame:
    """Analyses and experiments of one dataset version."""
    wanted = nodes.where((F.col("name") == name) & (F.col("version") == version)).select(F.col("id").alias("source"))
    return (edges.join(wanted, "source", "left_semi").join(
        nodes.where(F.col("type").isin("analysis", "experiment")).select(F.col("id").alias("target"), "type"), "target")
        .select("type", F.col("target").alias("id"), "relationship"))


def append(nodes_path: str, edges_path: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Add nodes with their edges to the written tables."""
    nodes.write.mode("append").parquet(nodes_path)
    edges.write.mode("append").parquet(edges_path)


def orphans(snapshots: DataFrame, relations: DataFrame) -> DataFrame:
    """Snapshots (id, alias, created_at) without relation or alias that are not the latest."""
    latest = snapshots.agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    keep = (relations.select(F.col("source").alias("id")).unionByName(relations.select(F.col("target").alias("id")))
            .unionByName(latest))
    return snapshots.where(F.col("alias").isNull()).join(keep, "id", "left_anti")
