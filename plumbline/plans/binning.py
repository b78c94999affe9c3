"""Equal-width bins over a pooled range.

Bins are half-open, the last one closed; a constant attribute falls in bin 0. The
input is read twice, once for the ranges and once for the counts. The range table has
one row per attribute, i.e. per named column, which bounds what is broadcast; empty
bins are filled in from the packed counts of each attribute, not by another join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import BASE, TARGET


def bin_index(x: Column | str, lo: Column, hi: Column, bins: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    raw = F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    return F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")


def bin_center(bin_: Column, lo: Column, hi: Column, bins: int) -> Column:
    return lo + (hi - lo) * (bin_ + 0.5) / bins


def fill_bins(counts: DataFrame, bins: int, names: list[str]) -> DataFrame:
    """(attr, bin, lo, hi, names...) -> all bins of each attribute, with ``<name>_total``.

    At most ``bins`` entries are packed per attribute.
    """
    packed = counts.groupBy("attr").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(n).alias(f"{n}_total") for n in names],
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct(*names)))).alias("_m"))
    rows = packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) \
        .withColumn("_n", F.try_element_at("_m", F.col("bin")))
    return rows.select("attr", "bin", "lo", "hi", *[F.coalesce(f"_n.{n}", F.lit(0)).alias(n) for n in names],
                       *[f"{n}_total" for n in names])


def _count(binned: DataFrame, bins: int, **counts: Column) -> DataFrame:
    return (binned.groupBy("attr", bin_index("value", F.col("lo"), F.col("hi"), bins).alias("bin"))
            .agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), *[c.alias(n) for n, c in counts.items()]))


def histogram(long: DataFrame, bins: int) -> DataFrame:
    """(attr, value) -> (attr, bin, lo, hi, n, n_total), empty bins included."""
    ranges = long.groupBy("attr").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return fill_bins(_count(long.join(F.broadcast(ranges), "attr"), bins, n=F.count("*")), bins, ["n"])


def paired_histogram(long: DataFrame, bins: int, edges: str = "common", ranges: DataFrame | None = None) -> DataFrame:
    """(side, attr, value) -> (attr, bin, lo, hi, n_base, n_target, n_base_total, n_target_total).

    ``edges="baseline"`` takes the range from the baseline alone and drops target
    values outside of it. ``ranges`` (attr, lo, hi) saves a pass where it is known.
    """
    is_base, is_target = F.col("side") == BASE, F.col("side") == TARGET
    if ranges is None:
        seen = F.when(is_base, F.col("value")) if edges == "baseline" else F.col("value")
        ranges = long.groupBy("attr").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"))
    binned = long.join(F.broadcast(ranges.select("attr", "lo", "hi")), "attr")
    if edges == "baseline":
        binned = binned.where(F.col("value").between(F.col("lo"), F.col("hi")))
    counts = _count(binned, bins, n_base=F.count_if(is_base), n_target=F.count_if(is_target))
    return fill_bins(counts, bins, ["n_base", "n_target"])
