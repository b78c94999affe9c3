"""Comparisons of two tables, incremental refresh, saved views, keyed results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.frames import BASE, TARGET, two_sides, with_scalars


def added_removed(base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Counts of keys only in current, only in base, and in both."""
    b = base.select(key).distinct().withColumn("_b", F.lit(1))
    c = current.select(key).distinct().withColumn("_c", F.lit(1))
    j = b.join(c, key, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_c").isNull()).alias("removed"),
                 F.count_if(F.col("_b").isNotNull() & F.col("_c").isNotNull()).alias("common"))


def incremental_changes(cached: DataFrame, current: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(path, size, mtime) manifests: new, removed, modified or unchanged per path."""
    a = cached.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.lit(1).alias("_a"))
    b = current.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"), F.lit(1).alias("_b"))
    state = (F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed")
             .when((F.col("s0") != F.col("s1")) | (F.abs(F.col("m0") - F.col("m1")) > tolerance), "modified")
             .otherwise("unchanged"))
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def incremental_refresh(cached: DataFrame, current: DataFrame, changes: DataFrame, key: str,
                        compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Recompute the new and modified rows, keep the unchanged results, drop the removed."""
    todo = changes.where(F.col("state").isin("new", "modified")).select(key)
    keep = changes.where(F.col("state") == "unchanged").select(key)
    fresh = compute(current.join(todo, key, "left_semi")).withColumn("recomputed", F.lit(True))
    kept = cached.join(keep, key, "left_semi").withColumn("recomputed", F.lit(False))
    return kept.unionByName(fresh)


def count_drift(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(side, ...) rows: counts per key on both sides and their difference, missing counts as 0.

    Both sides are counted by one aggregation instead of joining two.
    """
    counts = df.groupBy(key.alias(name)).agg(
        F.count_if(F.col("side") == BASE).alias("base"), F.count_if(F.col("side") == TARGET).alias("target"))
    return counts.withColumn("delta", F.col("target") - F.col("base"))


def stats_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, value) statistics: right - left per key, missing or null counts as 0, sorted."""
    a, b = left.select("key", F.col("value").alias("l")), right.select("key", F.col("value").alias("r"))
    zero = F.lit(0.0)
    return (a.join(b, "key", "full_outer")
            .select("key", (F.coalesce("r", zero) - F.coalesce("l", zero)).alias("diff")).orderBy("key"))


def row_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Added, removed, changed or same per key; columns are compared null-safe."""
    cols = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*cols).alias("_a"))
    b = new.select(key, F.struct(*cols).alias("_b"))
    state = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
             .when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed"))
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def apply_view(df: DataFrame, views: DataFrame, view: str, operation: str, key: str) -> DataFrame:
    """Keep only or remove the rows named by a saved view (name, key).

    A view that does not exist changes nothing; an unknown operation is an error.
    """
    if operation not in ("keep_only", "remove"):
        raise ValueError(f"unknown operation {operation!r}")
    named = views.where(F.col("name") == view).select(key)
    if operation == "remove":
        return df.join(named, key, "left_anti")
    if named.isEmpty():
        return df
    return df.join(named, key, "left_semi")


def preview_view(df: DataFrame, views: DataFrame, view: str, operation: str, key: str, n: int = 10) -> DataFrame:
    """First keys to be removed, with the counts to remove and to keep."""
    if operation not in ("keep_only", "remove"):
        raise ValueError(f"unknown operation {operation!r}")
    named = views.where(F.col("name") == view).select(key).distinct().withColumn("_hit", F.lit(True))
    marked = df.select(key).join(named, key, "left")
    if operation == "remove":
        gone = F.col("_hit").isNotNull()
    else:
        gone = F.col("_hit").isNull() if not named.isEmpty() else F.lit(False)
    counts = marked.agg(F.count_if(gone).alias("to_remove"), F.count_if(~gone).alias("to_keep"))
    return with_scalars(marked.where(gone).select(key).orderBy(key).limit(n), counts)


def normal_path(path: Column) -> Column:
    """Lower-case host and path without scheme, query, fragment, ``www.``/``m.`` and trailing slash."""
    bare = F.regexp_replace(F.lower(path), r"^[a-z]+://(www\.|m\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")


def duplicate_registrations(df: DataFrame, key: str, path: str) -> DataFrame:
    """Rows whose normalised path was already registered by a smaller key.

    The first key per path is found by an aggregation that merges before its shuffle;
    a path held by very many rows is then one row on the small side of the join.
    """
    named = df.select(key, normal_path(F.col(path)).alias("norm_path"))
    first = named.groupBy("norm_path").agg(F.min(key).alias("first_key"), F.count("*").alias("n")).where("n > 1")
    return named.join(first, "norm_path").where(F.col(key) != F.col("first_key")).drop("n")


def stacked(base: DataFrame, target: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Values of both sides in long form, for box and violin data."""
    both = two_sides(base, target).select("side", key, *[F.col(c).cast("double").alias(c) for c in columns])
    return both.unpivot(["side", key], list(columns), "attr", "value")


def upsert_results(existing: DataFrame, new: DataFrame, force: bool = True) -> DataFrame:
    """One result per (base_id, target_id): the newest one, or the existing one unless forced."""
    cols = existing.columns
    rank = F.col("created_at") if force else F.when(F.col("_old"), F.lit(1)).otherwise(F.lit(0))
    both = existing.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
    packed = both.groupBy("base_id", "target_id").agg(
        F.max_by(F.struct(*cols), F.struct(rank, F.col("created_at"))).alias("_r"))
    return packed.select("_r.*")


def overall_score(result: Column) -> Column:
    """First overall score among the shapes a result JSON may have."""
    modality_scores = F.filter(
        F.map_values(F.from_json(F.get_json_object(result, "$.modalities"), "map<string,string>")),
        lambda m: F.get_json_object(m, "$.ensemble.overall_score").isNotNull())
    return F.coalesce(
        F.get_json_object(result, "$.advanced_drift.ensemble.overall_score"),
        F.get_json_object(result, "$.ensemble.overall_score"),
        F.get_json_object(F.get(modality_scores, F.lit(0)), "$.ensemble.overall_score"),
        F.get_json_object(result, "$.overall_score")).try_cast("double")
