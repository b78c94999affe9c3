"""Profiles of tables, texts and numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.binning import bin_center, histogram
from ..plans.cdf import at_rank, moments, percentile, summary, value_counts
from ..plans.frames import exact_sample, to_long, with_scalars
from ..plans.scratch import cut


def shape_preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """The first rows by key with the row and column count of the table."""
    size = df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
    return with_scalars(df.orderBy(key).limit(rows), size)


def missing_rate(df: DataFrame) -> DataFrame:
    """Share of null or empty values per column, to 4 decimals."""
    shares = df.agg(*[
        F.avg(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), 1.0).otherwise(0.0)).alias(c)
        for c in df.columns])
    return shares.unpivot([], df.columns, "column", "rate") \
        .select("column", F.round("rate", 4).alias("missing_rate"))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    s = summary(to_long(df, columns, ids=()), ["attr"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return s.select(F.col("attr").alias("column"), F.col("n").alias("count"), "mean", F.col("std_samp").alias("std"),
                    "min", "max", "p25", "p50", "p75")


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct values, most frequent value (smallest on ties) and its count."""
    values = (df.select(*[F.col(c).cast("string").alias(c) for c in columns])
              .unpivot([], columns, "column", "v").where("v IS NOT NULL AND v <> ''")
              .groupBy("column", "v").agg(F.count("*").alias("n")))
    return values.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"),
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"), F.max("n").alias("freq"))


def attribute_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, total, min, max, mean, population deviation and median per attribute."""
    s = summary(to_long(df, columns, ids=()), ["attr"], "value", {"median": 0.5})
    return s.select("attr", "n", "total", "min", "max", "mean", F.col("std_pop").alias("std"), "median")


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), column).limit(n))


def attribute_histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    h = histogram(to_long(df, columns, ids=()), bins)
    return h.select("attr", "bin", F.round(bin_center(F.col("bin"), F.col("lo"), F.col("hi"), bins), 4)
                    .alias("center"), "n")


def quality_map(df: DataFrame, key: str, noise: str, sharpness: str, n: int = 100, seed: int = 42) -> DataFrame:
    """(noise, sharpness) points, a repeatable random sample of n."""
    return exact_sample(df.select(key, F.col(noise).alias("noise"), F.col(sharpness).alias("sharpness")),
                        n, key, seed)


def line_stats(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Lines, mean and maximum words per line."""
    lines = df.select(*keys, F.explode(F.split(text, "\n")).alias("line"))
    words = F.regexp_count(F.lower("line"), F.lit(r"[\p{L}\p{N}_]+"))
    return lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.avg(words).alias("mean_words"),
                                    F.max(words).alias("max_words"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return (df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")))


def top_words(df: DataFrame, text: str, n: int = 20) -> DataFrame:
    return word_counts(df, text).orderBy(F.desc("n"), "word").limit(n)


def categorical_profile(df: DataFrame, column: str) -> DataFrame:
    """Frequency per value with distinct count and entropy; null rows count in the divisor."""
    counts = cut(df.groupBy(column).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("n_rows"))
    known = with_scalars(counts, total).where(F.col(column).isNotNull())
    p = F.col("n") / F.col("n_rows")
    whole = known.agg(F.count("*").alias("n_distinct"), (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"))
    return with_scalars(known.select(F.col(column).alias("value"), "n", p.alias("share")), whole)


def _entropy(counts: DataFrame, base2: bool) -> DataFrame:
    """Entropy of the bin counts ``n`` per attribute; a window holds the bins of one attribute."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("attr"))
    shares = counts.where("n > 0").select("attr", p.alias("p"))
    return shares.groupBy("attr").agg((-F.sum(F.col("p") * (F.log2("p") if base2 else F.ln("p")))).alias("entropy"))


def unit_histogram_entropy(long: DataFrame, bins: int = 256) -> DataFrame:
    """Entropy in bits of equal bins on [0, 1]; values outside are not counted."""
    bin_ = F.least(F.floor(F.col("value") * bins), F.lit(bins - 1))
    return _entropy(long.where(F.col("value").between(0, 1)).groupBy("attr", bin_.alias("bin"))
                    .agg(F.count("*").alias("n")), True)


def positive_histogram_entropy(long: DataFrame, bins: int = 50) -> DataFrame:
    """Entropy in nats of equal bins over the positive values."""
    return _entropy(histogram(long.where("value > 0"), bins), False)


# Percentiles of the positive values and the ratios between them.
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]
RATIOS = [(95, 5), (90, 10), (99, 50), (75, 25)]


def distribution_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Shape of the positive values of each group and quartiles of all its values.

    Positive values come last in the order, so their ranks are a second running count
    over the same table of distinct values.
    """
    positive = F.when(F.col("v") > 0, F.col("n")).otherwise(F.lit(0).cast("bigint"))
    vc = value_counts(df, [key], value, {"cp": positive, "sp": positive * F.col("v")}).withColumn("np", positive)
    mean, mean_p = F.col("s_total") / F.col("c_total"), F.col("sp_total") / F.nullif("cp_total", F.lit(0))
    n, n_p = F.max("c_total"), F.max("cp_total")
    var_p = moments(mean_p, F.col("np"), 2) / F.nullif(n_p, F.lit(0))
    skewness = moments(mean_p, F.col("np"), 3) / F.nullif(n_p, F.lit(0)) / F.nullif(F.pow(var_p, 1.5), F.lit(0.0))
    out = vc.groupBy(key).agg(
        n.alias("n"), n_p.alias("n_positive"), F.max(mean).alias("mean"),
        F.sqrt(moments(mean, F.col("n"), 2) / n).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.coalesce(skewness, F.lit(0.0)).alias("skewness"),
        *[percentile(p / 100, "cp", "np").alias(f"p{p}") for p in PERCENTILES],
        percentile(0.25).alias("q25"), percentile(0.5).alias("q50"), percentile(0.75).alias("q75"),
        percentile(0.9).alias("threshold_90"),
        # all rows after the value at the lower rank lie above the threshold
        (n - at_rank(0.9, result=F.col("c"))).alias("n_high"))
    for hi, lo in RATIOS:
        out = out.withColumn(f"p{hi}_p{lo}", F.col(f"p{hi}") / F.nullif(f"p{lo}", F.lit(0.0)))
    few, none = F.col("n_positive") < 3, F.col("n_positive") == 0
    spread = F.nullif(F.col("p90") - F.col("p10"), F.lit(0.0))
    return (out
            .withColumn("skewness", F.when(few, F.lit(0.0)).otherwise(F.col("skewness")))
            .withColumn("percentile_skewness", F.when(few, F.lit(0.0)).otherwise(
                F.coalesce((F.col("p90") + F.col("p10") - 2 * F.col("p50")) / spread, F.lit(0.0))))
            .withColumn("shape", F.when(none, "no_activation").when(few, "insufficient_data")
                        .when(F.abs("skewness") < 0.5, "symmetric").when(F.col("skewness") > 0.5, "right_skewed")
                        .otherwise("left_skewed"))
            .withColumn("concentration", F.when(F.col("p95_p5") > 10, "high").when(F.col("p95_p5") > 5, "moderate")
                        .otherwise("low"))
            .withColumn("activation_ratio", F.col("n_positive") / F.col("n") * 100)
            .withColumn("iqr", F.col("q75") - F.col("q25")))


def quality_buckets(df: DataFrame) -> DataFrame:
    """(overlap, entropy, components, class_name) results counted by quality: (bucket, n)."""
    o, e, c = F.col("overlap"), F.col("entropy"), F.col("components")
    buckets = {
        "high_quality": o > 0.5, "medium_quality": (o > 0.3) & (o <= 0.5), "low_quality": (o > 0) & (o <= 0.3),
        "no_detection": ~(o > 0), "high_entropy": e > 2.0, "low_entropy": e <= 1.0,
        "complex_components": c > 5, "simple_components": c <= 2,
        "excellent": o > 0.5, "good": (o > 0.3) & (o <= 0.5), "poor": ~(o > 0.3)}
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(v).alias(k) for k, v in buckets.items()])
    counted = wide.unpivot([], ["total", *buckets], "bucket", "n")
    classes = df.groupBy(F.concat(F.lit("class:"), F.coalesce("class_name", F.lit("Unknown"))).alias("bucket")) \
        .agg(F.count("*").alias("n"))
    return counted.unionByName(classes)


# ---- item tables -----------------------------------------------------------

def dataset_stats(items: DataFrame) -> DataFrame:
    """(section, name, value): items by split and class, size in MB, sizes of the pictures."""
    by_split = items.groupBy(F.coalesce("split", F.lit("unknown")).alias("name")).agg(
        F.count("*").cast("double").alias("value")).select(F.lit("split").alias("section"), "name", "value")
    by_class = items.select(F.explode("classes").alias("name")).groupBy("name").agg(
        F.count("*").cast("double").alias("value")).select(F.lit("class").alias("section"), "name", "value")
    whole = items.agg(
        F.count("*").cast("double").alias("items"), (F.sum("size_bytes") / 1048576).alias("total_mb"),
        *[f(c).cast("double").alias(f"{n}_{c}") for c in ("width", "height")
          for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    totals = whole.unpivot([], whole.columns, "name", "value").select(F.lit("total").alias("section"), "name", "value")
    return by_split.unionByName(by_class).unionByName(totals)


def class_split_counts(df: DataFrame, split: str, cls: str, image: str) -> DataFrame:
    """Annotations and distinct images per split and class."""
    return df.groupBy(F.col(split).alias("split"), F.col(cls).alias("class")).agg(
        F.count("*").alias("n_labels"), F.count_distinct(image).alias("n_images"))


def annotation_summary(annotations: DataFrame) -> DataFrame:
    """(format, class) annotations: count per class and in total per format."""
    per = annotations.groupBy("format", "class").agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.partitionBy("format")))


