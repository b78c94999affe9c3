"""Drift of single attributes on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from .sqlparts import (LINE_COLUMNS, LINE_LONG, cdf_ctes, hist_ctes, kl_ctes, psi_ctes, sides, skew,
                       text_attributes, unpivot)
from ..functions.scalar import status_label
from ..functions.text import ATTRIBUTES, with_text_attributes
from ..operators import baselines, drift
from ..plans.frames import BASE, TARGET, r, split_sides, spread, to_long
from ..plans.scratch import cut, written

# split of the events at their middle day
EVENTS_CUT = "2024-01-16"


def line_pair(spark, sf):
    """Lines with return flag A against R, long form."""
    df = table(spark, sf, "lineitem").select("l_returnflag", *LINE_COLUMNS)
    df = split_sides(df, F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")
    return to_long(df, LINE_COLUMNS)


def price_by_quantity(spark, sf):
    """Prices of small against large lines: a real shift."""
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    df = split_sides(df, F.col("l_quantity") <= 25, F.col("l_quantity") > 25)
    return to_long(df.withColumnRenamed("l_extendedprice", "price_by_quantity"), ["price_by_quantity"])


PRICE_LONG = ("SELECT " + sides("l_quantity <= 25") + " AS side, 'price_by_quantity' AS attr, "
              "l_extendedprice AS value FROM lineitem")
PAIR_LONG = LINE_LONG + " UNION ALL " + PRICE_LONG


def pair_long(spark, sf):
    return line_pair(spark, sf).unionByName(price_by_quantity(spark, sf))


def events_halves(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    cut = F.to_timestamp(F.lit(EVENTS_CUT))
    return split_sides(df, F.col("ts") < cut, F.col("ts") >= cut)


@query("drift_psi", f"""WITH {psi_ctes(PAIR_LONG)}
SELECT attr, round(score, 6) + 0.0 AS score,
       CASE WHEN score < 0.15 THEN 'NORMAL' WHEN score < 0.25 THEN 'WARNING' ELSE 'CRITICAL' END AS status
FROM psi""")
def drift_psi(spark, sf):
    return drift.psi(pair_long(spark, sf)).select("attr", r("score").alias("score"),
                                                  status_label(F.col("score")).alias("status"))


@query("drift_kl", f"""WITH {kl_ctes(PAIR_LONG)} SELECT attr, round(score, 4) + 0.0 AS score FROM kl""")
def drift_kl(spark, sf):
    return drift.kl(pair_long(spark, sf))


@query("status_label", f"""WITH {psi_ctes(PAIR_LONG)}
SELECT attr, CASE WHEN score < 0.15 THEN 'NORMAL' WHEN score < 0.25 THEN 'WARNING' ELSE 'CRITICAL' END AS status,
       CASE WHEN score < 0.0001 THEN 'NORMAL' WHEN score < 0.001 THEN 'WARNING' ELSE 'CRITICAL' END AS strict_status
FROM psi""")
def status_labels(spark, sf):
    scores = drift.psi(pair_long(spark, sf))
    return scores.select("attr", status_label(F.col("score")).alias("status"),
                         status_label(F.col("score"), 0.0001, 0.001).alias("strict_status"))


@query("drift_mean_delta", f"""WITH long AS ({PAIR_LONG})
SELECT attr, round(b, 4) AS base_mean, round(t, 4) AS target_mean, round(t - b, 4) + 0.0 AS delta
FROM (SELECT attr, avg(value) FILTER (side = 'base') AS b, avg(value) FILTER (side = 'target') AS t
      FROM long GROUP BY attr)""")
def drift_mean_delta(spark, sf):
    return drift.mean_delta(pair_long(spark, sf))


@query("drift_attr_stats", f"""WITH {kl_ctes(PAIR_LONG)}
SELECT attr, round(kl.score, 4) + 0.0 AS kl, round(avg(value) FILTER (side = 'base'), 4) AS base_mean,
       round(avg(value) FILTER (side = 'target'), 4) AS target_mean,
       round(stddev_pop(value) FILTER (side = 'base'), 4) AS base_std,
       round(stddev_pop(value) FILTER (side = 'target'), 4) AS target_std
FROM long JOIN kl USING (attr) GROUP BY attr, kl.score""")
def drift_attr_stats(spark, sf):
    return drift.attribute_stats(pair_long(spark, sf))


@query("attr_histogram_pair", f"""WITH {hist_ctes(PAIR_LONG, 20)}
SELECT attr, CAST(bin AS INTEGER) AS bin, round(lo + (hi - lo) * (bin + 0.5) / 20, 4) AS center, n_base, n_target
FROM h""")
def attr_histogram_pair(spark, sf):
    return drift.pair_histogram(pair_long(spark, sf), 20)


@query("drift_wasserstein", f"""WITH {cdf_ctes(PAIR_LONG)} SELECT attr, round(score, 6) + 0.0 AS score FROM w1""")
def drift_wasserstein(spark, sf):
    return drift.wasserstein(pair_long(spark, sf)).select("attr", r("score").alias("score"))


TEXT_LONG = unpivot(ATTRIBUTES, f"({text_attributes()})", sides("lang = 'en'"), "lang IN ('en', 'fr')")


def text_pair(spark, sf):
    """Text attributes of English against French documents."""
    df = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    df = split_sides(df, F.col("lang") == "en", F.col("lang") == "fr")
    return with_text_attributes(df, "text", F.col("lang"))


@query("drift_wasserstein_rel", f"""WITH {cdf_ctes(TEXT_LONG)},
m AS (SELECT attr, greatest(abs(avg(value)), 1.0) AS m FROM long WHERE side = 'base' GROUP BY attr)
SELECT attr, round(score / m, 6) + 0.0 AS score FROM w1 JOIN m USING (attr)""")
def drift_wasserstein_rel(spark, sf):
    return drift.wasserstein_relative(to_long(text_pair(spark, sf), ATTRIBUTES)) \
        .select("attr", r("score").alias("score"))


PROFILE_SQL = f"""avg(value) AS mean, var_samp(value) AS variance, {skew('value')} AS skewness,
 kurtosis_pop(value) AS kurtosis"""


@query("drift_moments", f"""WITH ev AS (SELECT *, {sides("ts < TIMESTAMP '" + EVENTS_CUT + "'")} AS side FROM events),
prof AS (SELECT event_type, side, {PROFILE_SQL} FROM ev GROUP BY ALL),
lng AS (SELECT * FROM prof UNPIVOT (v FOR metric IN (mean, variance, skewness, kurtosis))),
prs AS (SELECT event_type, metric, max(v) FILTER (side = 'base') AS b, max(v) FILTER (side = 'target') AS t
        FROM lng GROUP BY ALL)
SELECT round(coalesce(avg(abs(b - t)), 0), 4) + 0.0 AS score, count(b - t) AS n_compared FROM prs""")
def drift_moments(spark, sf):
    return drift.moments_drift(events_halves(spark, sf), "event_type") \
        .select(r("score", 4).alias("score"), "n_compared")


SUMMARY_SQL = """SELECT 'rows' AS key, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE year(o_orderdate) = {y}
UNION ALL SELECT 'price_mean', avg(o_totalprice) FROM orders WHERE year(o_orderdate) = {y}
UNION ALL SELECT 'price_max', max(o_totalprice) FROM orders WHERE year(o_orderdate) = {y}
UNION ALL SELECT 'customers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders WHERE year(o_orderdate) = {y}"""


def orders_by_year(spark, sf):
    """(year, key, value): the summary of the orders of each year, values as text."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    s = o.groupBy("year").agg(F.count("*").cast("double").alias("rows"), F.avg("o_totalprice").alias("price_mean"),
                              F.max("o_totalprice").alias("price_max"),
                              F.count_distinct("o_custkey").cast("double").alias("customers"))
    s = cut(s)  # one row per year
    return s.unpivot(["year"], ["rows", "price_mean", "price_max", "customers"], "key", "value")


@query("drift_summary_relative", f"""WITH a AS ({SUMMARY_SQL.format(y=1996)}), b AS ({SUMMARY_SQL.format(y=1997)}),
d AS (SELECT key, abs(b.value - a.value) / (abs(a.value) + 1e-10) AS change FROM a JOIN b USING (key))
SELECT key, round(change, 6) + 0.0 AS change, round((SELECT avg(change) FROM d), 6) + 0.0 AS overall FROM d""")
def drift_summary_relative(spark, sf):
    from ..plans.frames import with_scalars
    s = orders_by_year(spark, sf)
    d = drift.summary_relative(s.where("year = 1996"), s.where("year = 1997"))
    return with_scalars(d, d.agg(F.avg("change").alias("overall"))) \
        .select("key", r("change").alias("change"), r("overall").alias("overall"))


ORDER_LONG = unpivot(["o_totalprice", "o_custkey"], "orders", sides("o_orderstatus = 'O'"),
                     "o_orderstatus IN ('O', 'F')")


@query("drift_columns_flagged", f"""WITH {cdf_ctes(ORDER_LONG)},
cat AS (SELECT attr, cat, count(*) FILTER (side = 'base') AS b, count(*) FILTER (side = 'target') AS t FROM (
  SELECT {sides("o_orderstatus = 'O'")} AS side, o_orderpriority, CAST(month(o_orderdate) AS VARCHAR) AS o_month
  FROM orders WHERE o_orderstatus IN ('O', 'F')) UNPIVOT (cat FOR attr IN (o_orderpriority, o_month)) GROUP BY ALL),
sh AS (SELECT attr, b / sum(b) OVER (PARTITION BY attr) AS p, t / sum(t) OVER (PARTITION BY attr) AS q FROM cat),
js AS (SELECT attr, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
   + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS score FROM sh GROUP BY attr),
f AS (SELECT attr, score, 'ks' AS test, score > 0.1 AS drifted FROM ks
      UNION ALL SELECT attr, score, 'jensen_shannon', score > 0.1 FROM js)
SELECT attr, round(score, 6) + 0.0 AS score, test, drifted,
       (SELECT avg(CAST(drifted AS INTEGER)) FROM f) AS overall FROM f""")
def drift_columns_flagged(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_month", F.month("o_orderdate"))
    o = split_sides(o, F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F")
    return drift.columns_flagged(o, ["o_totalprice", "o_custkey"], ["o_orderpriority", "o_month"]) \
        .select("attr", r("score").alias("score"), "test", "drifted", "overall")


IMAGE_COLUMNS = {"brightness": "vocab_diversity", "contrast": "whitespace_ratio", "sharpness": "readability",
                 "entropy": "stopword_ratio", "noise_level": "special_char_ratio", "size": "length_chars"}


def image_table(spark, sf):
    """Text attributes under the names of an image attribute table."""
    df = text_pair(spark, sf)
    return df.select("side", *[F.col(v).alias(k) for k, v in IMAGE_COLUMNS.items()])


_IMAGE_SQL = ", ".join(f"{v} AS {k if k != 'noise_level' else 'gaussian_noise_level'}"
                       for k, v in IMAGE_COLUMNS.items())
IMAGE_LONG = unpivot([k if k != "noise_level" else "gaussian_noise_level" for k in IMAGE_COLUMNS],
                     f"(SELECT lang, {_IMAGE_SQL} FROM ({text_attributes()}))", sides("lang = 'en'"),
                     "lang IN ('en', 'fr')")
IMAGE_NAMES = ", ".join(f"('{a}')" for a in [*drift.IMAGE_ATTRIBUTES, "size"])


@query("drift_image_attrs", f"""WITH {psi_ctes(IMAGE_LONG)},
s AS (SELECT n.attr, coalesce(score, 0.0) AS score FROM (VALUES {IMAGE_NAMES}) n(attr) LEFT JOIN psi USING (attr))
SELECT attr, round(score, 6) + 0.0 AS score FROM s
UNION ALL SELECT 'overall', round(avg(score), 6) + 0.0 FROM s WHERE attr <> 'size'""")
def drift_image_attrs(spark, sf):
    return drift.image_attribute_drift(image_table(spark, sf)).select("attr", r("score").alias("score"))


@query("baseline_compare", f"""WITH {cdf_ctes(LINE_LONG)}, sides AS (SELECT attr, count(*) FILTER (side = 'base') AS n_base, count(*) FILTER (side = 'target') AS n_target,
 min(value) AS lo, max(value) AS hi FROM long GROUP BY attr)
SELECT attr, n_base, n_target, lo, hi, round(ks.score, 6) + 0.0 AS exact_ks, round(w1.score, 6) + 0.0 AS exact_wasserstein, true AS ks_within, true AS wasserstein_within
FROM sides JOIN ks USING (attr) JOIN w1 USING (attr)""")
def baseline_compare(spark, sf):
    """Baselines by line number, written, merged and compared without their rows; beside them the exact distances and whether the error holds.

    The error holds with a probability of 99 % for each side; twice the error is asked for here.
    """
    pair = line_pair(spark, sf)
    numbered = to_long(split_sides(table(spark, sf, "lineitem"), F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"), LINE_COLUMNS, ids=("side", "l_linenumber"))
    kept = written(baselines.baseline(numbered, ["side", "l_linenumber"]), "baselines")
    base, target = (baselines.merged(kept.where(F.col("side") == s)) for s in (BASE, TARGET))
    told = baselines.compare(base, target)
    exact = drift.kolmogorov_smirnov(pair).withColumnRenamed("score", "exact_ks").join(
        drift.wasserstein(pair).withColumnRenamed("score", "exact_wasserstein"), "attr")
    both = told.join(exact, "attr")
    return both.select(
        "attr", "n_base", "n_target", "lo", "hi", r("exact_ks").alias("exact_ks"), r("exact_wasserstein").alias("exact_wasserstein"),
        (F.abs(F.col("ks") - F.col("exact_ks")) <= 2 * F.col("ks_error")).alias("ks_within"),
        (F.abs(F.col("wasserstein") - F.col("exact_wasserstein")) <= 2 * F.col("wasserstein_error")).alias("wasserstein_within"))
