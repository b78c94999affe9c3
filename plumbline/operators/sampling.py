"""Repeatable samples and splits, ordered by a seeded hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.frames import exact_sample, join_few, sample_order, with_scalars
from ..plans.ordered import numbered
from ..plans.scratch import cut


def sample_random(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (all if there are fewer)."""
    return exact_sample(df, n, key, seed)


def sample_stratified(df: DataFrame, cls: Column, n: int, key: str, seed: int = 42) -> DataFrame:
    """Per class max(1, int(n * share)) rows; no class counts as "unknown".

    No class may take more than n rows, and that constant bound on the row number
    lets Spark cut every class to n rows before the shuffle.
    """
    named = df.withColumn("stratum", F.coalesce(cls, F.lit("unknown"))).withColumn("_h", sample_order(key, seed))
    counts = cut(named.groupBy("stratum").agg(F.count("*").alias("_n")))
    quota = with_scalars(counts, counts.agg(F.sum("_n").alias("_all"))).select(
        "stratum", F.greatest(F.lit(1), F.floor(n * F.col("_n") / F.col("_all"))).alias("_quota"))
    ranked = named.withColumn("_rn", F.row_number().over(
        Window.partitionBy("stratum").orderBy("_h", key))).where(F.col("_rn") <= n)
    return join_few(ranked, quota, "stratum").where(F.col("_rn") <= F.col("_quota")).drop("_h", "_rn", "_quota")


def sample_threshold(df: DataFrame, size: str, min_size: float = 0, max_size: float = float("inf")) -> DataFrame:
    return df.where(F.col(size).between(min_size, max_size))


def split_ratio(df: DataFrame, key: str, ratios: Sequence[float] = (0.4, 0.4, 0.2),
                names: Sequence[str] = ("reference", "current", "target"),
                train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Shuffle by hash, cut by ratio, then cut each part into disjoint train and valid.

    The last part takes what is left. Adds ``part`` and ``split``.
    """
    ranked = numbered(df.withColumn("_h", sample_order(key, seed)), [], ["_h", key], "_pos")
    total, pos = F.col("_pos_total"), F.col("_pos")
    start, bounds = F.lit(0).cast("bigint"), []
    for i, (ratio, name) in enumerate(zip(ratios, names)):
        size = (total - start) if i == len(ratios) - 1 else F.floor(total * ratio)
        bounds.append((name, start, size))
        start = start + size
    part = split = None
    for name, first, size in bounds:
        inside = (pos >= first) & (pos < first + size)
        kind = F.when(pos - first < F.floor(size * train_share), "train").otherwise("valid")
        part = F.when(inside, F.lit(name)) if part is None else part.when(inside, F.lit(name))
        split = F.when(inside, kind) if split is None else split.when(inside, kind)
    return ranked.withColumn("part", part).withColumn("split", split).drop("_h", "_pos", "_pos_total")


def pairs_with_label(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(split, stem) images with their label, ``has_label`` false where there is none."""
    known = labels.select("split", "stem", *[c for c in labels.columns if c not in ("split", "stem")],
                          F.lit(True).alias("_hit"))
    return images.join(known, ["split", "stem"], "left").withColumn(
        "has_label", F.coalesce("_hit", F.lit(False))).drop("_hit")


def unmatched_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(images, ["split", "stem"], "left_anti")


def materialize(sample: DataFrame, path: str, name: str, strategy: str, params: str) -> DataFrame:
    """Write a sample and return its one-row description, counted from the written files."""
    sample.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = sample.sparkSession
    meta = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("name"), F.lit(strategy).alias("strategy"), F.lit(params).alias("params"), "n_rows")
    meta.write.mode("append").parquet(f"{path}/_samples")
    return spark.read.parquet(f"{path}/_samples")
