"""Exact distribution functions and percentiles without one task per attribute.

Rows are first reduced to distinct values with counts, then scanned in range chunks.
All that is asked about a column is read off that one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .frames import BASE, TARGET
from .ordered import scan


def paired_cdf(long: DataFrame) -> DataFrame:
    """(side, attr, value) -> one row per (attr, value) with both distribution functions.

    Columns: attr, value, next_value, f_base, f_target, n_base, n_target.
    """
    counts = long.groupBy("attr", "value").agg(
        F.count_if(F.col("side") == BASE).alias("n_base"),
        F.count_if(F.col("side") == TARGET).alias("n_target"))
    s = scan(counts, ["attr"], ["value"],
             running={"c_base": "n_base", "c_target": "n_target"}, lead={"next_value": "value"})
    return s.select("attr", "value", "next_value", "n_base", "n_target",
                    (F.col("c_base") / F.nullif("c_base_total", F.lit(0))).alias("f_base"),
                    (F.col("c_target") / F.nullif("c_target_total", F.lit(0))).alias("f_target"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, running: dict[str, Column] | None = None) -> DataFrame:
    """(keys..., v, n, c, c_total, s_total): distinct values, counts, ranks and sums per key.

    ``c`` is the number of rows up to and with the value. ``running`` adds more running
    sums over the columns v and n.
    """
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    sums = {"c": F.col("n"), "s": F.col("n") * F.col("v"), **(running or {})}
    return scan(counts, keys, ["v"], running=sums)


def at_rank(p: float, count: str = "c", own: str = "n", low: bool = True, result: Column | None = None) -> Column:
    """Aggregate: the value (or ``result``) of the row that holds the lower or upper rank of percentile p.

    Every distinct value knows the ranks it covers, so the wanted rows select themselves;
    the built-in exact percentile would hold all distinct values of a group in one task.
    """
    h = F.lit(float(p)) * (F.col(f"{count}_total") - 1)
    rank = F.floor(h) if low else F.ceil(h)
    holds = rank.between(F.col(count) - F.col(own), F.col(count) - 1)
    return F.max(F.when(holds, F.col("v") if result is None else result))


def percentile(p: float, count: str = "c", own: str = "n") -> Column:
    """Aggregate: exact percentile with linear interpolation over ``value_counts``."""
    h = F.lit(float(p)) * (F.max(f"{count}_total") - 1)
    lo, hi = at_rank(p, count, own, True), at_rank(p, count, own, False)
    return lo + (hi - lo) * (h - F.floor(h))


def moments(mean: Column, weight: Column, power: int) -> Column:
    """Aggregate: weighted sum of the given power of the distance to a mean known per row."""
    return F.sum(weight * F.pow(F.col("v") - mean, power))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact percentiles in long form: (keys..., p, q)."""
    names = {f"_q{i}": p for i, p in enumerate(probs)}
    wide = value_counts(df, keys, value).groupBy(*keys).agg(*[percentile(p).alias(n) for n, p in names.items()])
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(n).alias("q")) for n, p in names.items()])
    return wide.select(*keys, F.inline(pairs))


def summary(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Per key: n, total, mean, std_pop, std_samp, min, max and the named percentiles, from one reading."""
    vc = value_counts(df, keys, value)
    mean = F.col("s_total") / F.col("c_total")
    n, ss = F.max("c_total"), moments(mean, F.col("n"), 2)
    return vc.groupBy(*keys).agg(
        n.alias("n"), F.max("s_total").alias("total"), F.max(mean).alias("mean"), F.sqrt(ss / n).alias("std_pop"),
        F.when(n > 1, F.sqrt(ss / F.nullif(n - 1, F.lit(0)))).alias("std_samp"), F.min("v").alias("min"), F.max("v").alias("max"),
        *[percentile(p).alias(name) for name, p in probs.items()])
