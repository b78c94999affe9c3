"""Drift of single attributes between a baseline and a target.

Every function takes the long form (side, attr, value), so all attributes are
scored by one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.binning import bin_center, paired_histogram
from ..plans.cdf import paired_cdf
from ..plans.frames import BASE, TARGET, to_long, with_scalars
from ..plans.scratch import cut

def base_value(c: str = "value") -> Column:
    return F.when(F.col("side") == BASE, F.col(c))


def target_value(c: str = "value") -> Column:
    return F.when(F.col("side") == TARGET, F.col(c))


def mean_delta(long: DataFrame) -> DataFrame:
    """Base mean, target mean and their difference to 4 decimals."""
    means = long.groupBy("attr").agg(F.avg(base_value()).alias("b"), F.avg(target_value()).alias("t"))
    return means.select("attr", F.round("b", 4).alias("base_mean"), F.round("t", 4).alias("target_mean"),
                        (F.round(F.col("t") - F.col("b"), 4) + F.lit(0.0)).alias("delta"))


def psi_of_counts(hist: DataFrame, bins: int) -> DataFrame:
    """Stability index of paired counts with add-one smoothing; 0 for a constant or one-sided attribute."""
    p = (F.col("n_base") + 1) / (F.col("n_base_total") + bins)
    q = (F.col("n_target") + 1) / (F.col("n_target_total") + bins)
    empty = (F.max("hi") == F.max("lo")) | (F.max("n_base_total") == 0) | (F.max("n_target_total") == 0)
    return hist.groupBy("attr").agg(
        F.when(empty, F.lit(0.0)).otherwise(F.abs(F.sum((q - p) * F.ln(q / p)))).alias("score"))


def psi(long: DataFrame, bins: int = 10) -> DataFrame:
    return psi_of_counts(paired_histogram(long, bins), bins)


def kl(long: DataFrame, bins: int = 20, edges: str = "common", ranges: DataFrame | None = None) -> DataFrame:
    """Kullback-Leibler divergence of base from target to 4 decimals."""
    hist = paired_histogram(long, bins, edges, ranges)
    eps = 1e-10
    # adding eps to every share and dividing by their sum, 1 + bins * eps
    p = (F.col("n_base") / F.nullif("n_base_total", F.lit(0)) + eps) / (1 + bins * eps)
    q = (F.col("n_target") / F.nullif("n_target_total", F.lit(0)) + eps) / (1 + bins * eps)
    empty = (F.max("n_base_total") == 0) | (F.max("n_target_total") == 0) | (F.max("hi") == F.max("lo"))
    score = F.when(empty, F.lit(0.0)).otherwise(F.sum(p * F.ln(p / q)))
    return hist.groupBy("attr").agg((F.round(F.abs(score), 4) + F.lit(0.0)).alias("score"))


def _area() -> Column:
    """Aggregate over a paired cdf: area between the two functions, null if a side is empty."""
    gap = F.abs(F.col("f_base") - F.col("f_target")) * (F.col("next_value") - F.col("value"))
    both = F.count("f_base") * F.count("f_target") > 0
    return F.when(both, F.coalesce(F.sum(gap), F.lit(0.0)))


def wasserstein(long: DataFrame) -> DataFrame:
    """First Wasserstein distance: area between the two distribution functions."""
    return paired_cdf(long).groupBy("attr").agg(_area().alias("score"))


def kolmogorov_smirnov(long: DataFrame) -> DataFrame:
    return paired_cdf(long).groupBy("attr").agg(
        F.max(F.abs(F.col("f_base") - F.col("f_target"))).alias("score"))


def wasserstein_relative(long: DataFrame) -> DataFrame:
    """Wasserstein distance over the base mean, which counts as at least 1."""
    mean = F.sum(F.col("value") * F.col("n_base")) / F.nullif(F.sum("n_base"), F.lit(0))
    return paired_cdf(long).groupBy("attr").agg((_area() / F.greatest(F.abs(mean), F.lit(1.0))).alias("score"))


def pair_histogram(long: DataFrame, bins: int = 20) -> DataFrame:
    h = paired_histogram(long, bins)
    return h.select("attr", "bin", F.round(bin_center(F.col("bin"), F.col("lo"), F.col("hi"), bins), 4)
                    .alias("center"), "n_base", "n_target")


def attribute_stats(long: DataFrame) -> DataFrame:
    """KL score, mean and population deviation of both sides, to 4 decimals."""
    # one row per attribute, read off one pass and kept for the bins
    stats = cut(long.groupBy("attr").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.round(F.avg(base_value()), 4).alias("base_mean"),
        F.round(F.avg(target_value()), 4).alias("target_mean"),
        F.round(F.stddev_pop(base_value()), 4).alias("base_std"),
        F.round(F.stddev_pop(target_value()), 4).alias("target_std")))
    scores = kl(long, ranges=stats).withColumnRenamed("score", "kl")
    return scores.join(F.broadcast(stats.drop("lo", "hi")), "attr")


MOMENTS = ["mean", "variance", "skewness", "kurtosis"]


def numeric_profile(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample variance, population skewness and excess kurtosis of the non-null values."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.var_samp(value).alias("variance"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))


def moments_drift(df: DataFrame, series: str, value: str = "value") -> DataFrame:
    """Mean absolute difference of the four moments over the series on both sides."""
    prof = numeric_profile(df, [series, "side"], value).unpivot([series, "side"], MOMENTS, "metric", "v")
    pairs = prof.groupBy(series, "metric").agg(
        F.max(base_value("v")).alias("b"), F.max(target_value("v")).alias("t"))
    return pairs.agg(F.coalesce(F.avg(F.abs(F.col("b") - F.col("t"))), F.lit(0.0)).alias("score"),
                     F.count(F.col("b") - F.col("t")).alias("n_compared"))


def summary_relative(base: DataFrame, target: DataFrame) -> DataFrame:
    """(key, value) summaries of numeric keys: relative change per key present in both."""
    b = base.select("key", F.expr("try_cast(value AS double)").alias("v1"))
    t = target.select("key", F.expr("try_cast(value AS double)").alias("v2"))
    return (b.join(t, "key").where("v1 IS NOT NULL AND v2 IS NOT NULL")
            .select("key", "v1", "v2",
                    (F.abs(F.col("v2") - F.col("v1")) / (F.abs("v1") + 1e-10)).alias("change")))


def jensen_shannon(df: DataFrame, columns: list[str]) -> DataFrame:
    """Jensen-Shannon distance (base 2) of category shares; null counts as a category."""
    # distinct categories with their counts, read twice below
    cats = cut(df.select("side", *[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot(["side"], columns, "attr", "cat")
            .groupBy("attr", "cat").agg(F.count_if(F.col("side") == BASE).alias("b"), F.count_if(F.col("side") == TARGET).alias("t")))
    totals = cats.groupBy("attr").agg(F.sum("b").alias("nb"), F.sum("t").alias("nt"))
    p, q = F.col("b") / F.col("nb"), F.col("t") / F.col("nt")
    m = (p + q) / 2

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    score = F.sqrt(F.greatest(F.sum((part(p) + part(q)) / 2), F.lit(0.0)))
    return cats.join(F.broadcast(totals), "attr").groupBy("attr").agg(score.alias("score"))


def columns_flagged(df: DataFrame, numeric: list[str], categorical: list[str],
                    threshold: float = 0.1) -> DataFrame:
    """Score, test and drifted flag per column, with the share of drifted columns.

    The tests are ours: Kolmogorov-Smirnov for numbers, Jensen-Shannon for categories.
    """
    ks = kolmogorov_smirnov(to_long(df, numeric)).withColumn("test", F.lit("ks"))
    js = jensen_shannon(df, categorical).withColumn("test", F.lit("jensen_shannon"))
    flagged = cut(ks.unionByName(js).withColumn("drifted", F.col("score") > threshold))
    overall = flagged.agg(F.avg(F.col("drifted").cast("double")).alias("overall"))
    return with_scalars(flagged, overall)


# The attributes of a picture.
IMAGE_ATTRIBUTES = ["brightness", "exposure", "contrast", "dynamic_range", "colorfulness",
                    "edge_density", "sharpness", "entropy", "gaussian_noise_level"]


def image_attribute_drift(df: DataFrame) -> DataFrame:
    """Stability index of the nine image attributes and of ``size``.

    An attribute without values scores 0; the noise level stands in for a missing
    gaussian noise level. The last rows are ``overall`` (mean of the nine) and ``size``.
    """
    have = set(df.columns)
    if "gaussian_noise_level" in have and "noise_level" in have:
        df = df.withColumn("gaussian_noise_level", F.coalesce("gaussian_noise_level", "noise_level"))
    elif "noise_level" in have:
        df = df.withColumn("gaussian_noise_level", F.col("noise_level"))
    present = [c for c in [*IMAGE_ATTRIBUTES, "size"] if c in df.columns]
    spark = df.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in [*IMAGE_ATTRIBUTES, "size"]])).alias("attr"))
    scored = cut(names.join(F.broadcast(psi(to_long(df, present))), "attr", "left")
                 .select("attr", F.coalesce("score", F.lit(0.0)).alias("score")))
    overall = scored.where(F.col("attr") != "size").agg(F.avg("score").alias("score")) \
        .select(F.lit("overall").alias("attr"), "score")
    return scored.unionByName(overall)
