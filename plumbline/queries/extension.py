"""The extension points in use."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from .drift import PAIR_LONG, line_pair, pair_long
from .profiles import SUMMARY_OF_LONG
from .sqlparts import LINE_COLUMNS, LINE_LONG, psi_ctes, text_attributes, unpivot
from ..functions import tables as functions
from ..functions.text import ATTRIBUTES, with_text_attributes
from ..operators import drift, profile
from ..operators.fusion import UnsupportedDetector
from ..operators.registry import Registry, register_sql, smoothed_shares
from ..plans.binning import paired_histogram
from ..plans.frames import r, to_long, two_sides


@query("register_profiler", f"""WITH long AS ({unpivot(ATTRIBUTES, f"({text_attributes()})", "'x'")}) {SUMMARY_OF_LONG}""")
def register_profiler(spark, sf):
    reg = Registry()
    reg.register_profiler("text", lambda df: profile.attribute_summary(
        with_text_attributes(df.select("text", "lang"), "text", F.col("lang")), ATTRIBUTES))
    s = reg.profile("text", table(spark, sf, "documents"))
    return s.select("attr", "n", r("total", 4).alias("total"), *[r(c).alias(c) for c in ("min", "max", "mean", "std", "median")])


@query("register_detector", f"""WITH {psi_ctes(PAIR_LONG)} SELECT attr, round(score, 6) + 0.0 AS score FROM psi WHERE attr <> 'price_by_quantity'""")
def register_detector(spark, sf):
    reg = Registry()
    reg.register_detector("tabular", "psi", lambda base, target, spec: drift.psi(
        to_long(two_sides(base, target), spec["columns"])), "equal-width bins")
    li = table(spark, sf, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = reg.detect("tabular", "psi", li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), {"columns": columns})
    return out.select("attr", r("score").alias("score"))


@query("detector_registry", f"""WITH {psi_ctes(LINE_LONG)} SELECT * FROM (VALUES
 ('audio', 'wasserstein', 'default,wasserstein', '', NULL), ('image', 'ensemble', 'cosine,default,ensemble,mean_shift,mmd,psi,wasserstein', '', NULL),
 ('text', 'ensemble', 'cosine,default,ensemble,mmd,mmd_only,psi', '', NULL), ('timeseries', 'moments', 'default,moments', '', NULL))
 t(modality, default_detector, supported, notes, flagged_columns)
UNION ALL SELECT 'tabular', 'psi', 'psi', 'equal-width bins', count(*) FILTER (score > 0.1) FROM psi""")
def detector_registry(spark, sf):
    """The declared detectors, with how many columns of the line pair each univariate one flags."""
    reg = Registry()
    reg.register_detector("tabular", "psi", lambda b, t, s: drift.psi(to_long(two_sides(b, t), s["columns"])), "equal-width bins")
    try:
        reg.check_detector("no-such-detector")
        raise AssertionError("an unknown detector was accepted")
    except UnsupportedDetector:
        pass
    flagged = drift.psi(line_pair(spark, sf)).agg(F.count_if(F.col("score") > 0.1).alias("flagged"))
    declared = reg.detector_table(spark)
    return declared.withColumn("supported", F.array_join("supported", ",")).withColumn("flagged_columns", F.when(F.col("modality") == "tabular", flagged.scalar()))


@query("register_transform", """SELECT doc_id, md5(reverse(text)) AS reversed, md5(text) AS unknown FROM documents""")
def register_transform(spark, sf):
    reg = Registry()
    reg.register_transform("text.reverse", F.reverse)
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(reg.transform("text.reverse", F.col("text"))).alias("reversed"),
                    F.md5(reg.transform("text.no_such", F.col("text"))).alias("unknown"))


@query("psi_udaf", f"""WITH {psi_ctes(PAIR_LONG)} SELECT attr, round(score, 6) + 0.0 AS score,
 CASE WHEN score < 0.15 THEN 'NORMAL' WHEN score < 0.25 THEN 'WARNING' ELSE 'CRITICAL' END AS status,
 (SELECT round(-sum(p * log2(p)), 6) + 0.0 FROM (SELECT n_base / nb AS p FROM h WHERE h.attr = psi.attr AND n_base > 0)) AS base_entropy FROM psi""")
def psi_udaf(spark, sf):
    register_sql(spark)
    h = paired_histogram(pair_long(spark, sf), 10)
    # ten bins per attribute
    packed = h.groupBy("attr").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "n_base"))), lambda x: x["n_base"]).alias("b"),
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "n_target"))), lambda x: x["n_target"]).alias("t"))
    shares = packed.select("attr", "b", smoothed_shares(F.col("b"), 10).alias("p"), smoothed_shares(F.col("t"), 10).alias("q"))
    shares.createOrReplaceTempView("plumbline_shares")
    s = spark.sql("""SELECT attr, psi_of_shares(p, q) AS score, drift_status(psi_of_shares(p, q)) AS status,
                     entropy_of_counts(b) AS base_entropy FROM plumbline_shares""")
    return s.select("attr", r("score").alias("score"), "status", r("base_entropy").alias("base_entropy"))


_TABLE_PSI = f"""rows AS (SELECT *, l_shipdate >= TIMESTAMP '1995-06-17' AS late FROM lineitem),
lng AS (SELECT l_linestatus, l_linenumber, late, attr, value::DOUBLE AS value FROM
 (SELECT l_linestatus, l_linenumber, late, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in LINE_COLUMNS)} FROM rows) UNPIVOT (value FOR attr IN ({', '.join(LINE_COLUMNS)}))),
rg AS (SELECT l_linestatus, l_linenumber, attr, min(value) AS lo, max(value) AS hi, count(*) FILTER (NOT late) AS nb, count(*) FILTER (late) AS nt FROM lng GROUP BY ALL),
ct AS (SELECT l_linestatus, l_linenumber, attr, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 10), 9) END AS bin,
 count(*) FILTER (NOT late) AS b, count(*) FILTER (late) AS t FROM lng JOIN rg USING (l_linestatus, l_linenumber, attr) GROUP BY ALL),
gd AS (SELECT rg.*, g.bin, coalesce(b, 0) AS b, coalesce(t, 0) AS t FROM rg CROSS JOIN (SELECT unnest(range(10)) AS bin) g
 LEFT JOIN ct ON ct.l_linestatus = rg.l_linestatus AND ct.l_linenumber = rg.l_linenumber AND ct.attr = rg.attr AND ct.bin = g.bin)"""


@query("psi_table_function", f"""WITH {_TABLE_PSI} SELECT l_linestatus, l_linenumber, attr, any_value(nb) AS n_base, any_value(nt) AS n_target,
 CASE WHEN any_value(nb) = 0 OR any_value(nt) = 0 THEN 0.0 ELSE round(abs(sum(((t + 1) / (nt + 10) - (b + 1) / (nb + 10)) * ln(((t + 1) / (nt + 10)) / ((b + 1) / (nb + 10))))), 6) + 0.0 END AS score
FROM gd GROUP BY l_linestatus, l_linenumber, attr""")
def psi_table_function(spark, sf):
    """Lines before and after a day, by status and line number, with table functions from SQL."""
    functions.register(spark)
    table(spark, sf, "lineitem").createOrReplaceTempView("plumbline_lines")
    late = "CASE WHEN l_shipdate >= TIMESTAMP_NTZ '1995-06-17' THEN 'target' ELSE 'base' END"
    out = functions.psi(spark, "plumbline_lines", late, LINE_COLUMNS, by=["l_linestatus", "l_linenumber"])
    return out.withColumn("score", r("score"))
