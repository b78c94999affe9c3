"""Baselines that are kept instead of rows: quantile sketches that merge.

A baseline has one row for each key and attribute: count, least and greatest value, sum, and a KLL
sketch of some kilobytes. Baselines of days or files merge into that of all of them, and two can
be compared without the rows that they were made of. All is Spark's own aggregation, partial
before the shuffle, so a large group costs a sketch for each task.

Both distribution functions are read off the sketches at the quantiles of both. Each is wrong
by at most ``rank_error(k)`` with a probability of 99 %, and by ``1 / POINTS`` between two quantiles; the sum of
this for both sides bounds the error of the Kolmogorov-Smirnov distance, and times the common range that
of the Wasserstein distance. Groups of up to k values are exact but for the points between.
The exact forms are ``drift.kolmogorov_smirnov`` and ``drift.wasserstein``; they need the rows.

Null, NaN and infinite values are left out by ``to_long``. An attribute that one side lacks has no
distances. An empty table has an empty baseline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Size of the sketches, and quantiles of each side at which distribution functions are compared.
K, POINTS = 400, 200


def rank_error(k: int = K) -> float:
    """Normalised rank error of a KLL sketch at 99 % (fixed formula of the published sketch library)."""
    return 2.296 / k ** 0.9723


def baseline(long: DataFrame, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """(keys..., attr, value) -> (keys..., attr, n, lo, hi, total, k, sketch)."""
    return long.groupBy(*keys, "attr").agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"),
        F.lit(k).alias("k"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")).where("n > 0")


def merged(baselines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The baseline of all rows together, for the keys that are left; the smallest sketch size counts."""
    return baselines.groupBy(*keys, "attr").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"),
        F.min("k").alias("k"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _quantiles(sketch: str) -> Column:
    shares = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])
    return F.kll_sketch_get_quantile_double(sketch, shares)


def compare(base: DataFrame, target: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., attr, n_base, n_target, lo, hi, ks, ks_error, wasserstein, wasserstein_error) of two baselines."""
    names = ("n", "lo", "hi", "total", "k", "sketch")
    both = base.withColumnsRenamed({c: f"{c}_b" for c in names}).join(target.withColumnsRenamed({c: f"{c}_t" for c in names}), [*keys, "attr"], "full")
    there = F.col("sketch_b").isNotNull() & F.col("sketch_t").isNotNull()
    seen = both.where(there).withColumn("q_b", _quantiles("sketch_b")).withColumn("q_t", _quantiles("sketch_t"))
    # a bounded number of points for each attribute
    points = F.array_sort(F.array_distinct(F.concat("q_b", "q_t", F.array("lo_b", "hi_b", "lo_t", "hi_t"))))

    def share(quantiles: str) -> Column:
        return F.transform("v", lambda v: F.size(F.filter(quantiles, lambda q: q <= v)) / POINTS)

    seen = seen.withColumn("v", points).withColumn("f", share("q_b")).withColumn("g", share("q_t"))
    gap = F.zip_with("f", "g", lambda a, b: F.abs(a - b))
    step = F.zip_with(F.slice("v", 2, F.size("v")), F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))), lambda a, b: a - b)
    area = F.aggregate(F.zip_with(F.slice(gap, 1, F.greatest(F.size("v") - 1, F.lit(0))), step, lambda d, w: d * w), F.lit(0.0), lambda a, x: a + x)

    def error(k: str) -> Column:
        return F.lit(2.296) / F.pow(F.col(k).cast("double"), 0.9723) + F.lit(1.0 / POINTS)

    lo, hi = F.least("lo_b", "lo_t"), F.greatest("hi_b", "hi_t")
    sides = [F.coalesce("n_b", F.lit(0)).alias("n_base"), F.coalesce("n_t", F.lit(0)).alias("n_target"), lo.alias("lo"), hi.alias("hi")]
    off = error("k_b") + error("k_t")
    none = [F.lit(None).cast("double").alias(c) for c in ("ks", "ks_error", "wasserstein", "wasserstein_error")]
    return seen.select(*keys, "attr", *sides, F.array_max(gap).alias("ks"), off.alias("ks_error"), area.alias("wasserstein"),
                       (off * (hi - lo)).alias("wasserstein_error")).unionByName(both.where(~there).select(*keys, "attr", *sides, *none))
