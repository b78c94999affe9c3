"""Profiles of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from .drift import PROFILE_SQL
from .sqlparts import LINE_COLUMNS, skew, text_attributes, unpivot
from ..functions import text as T
from ..functions.scalar import finite, finite_array, item_id, quality_score, split_of_path
from ..operators import drift, manifest, profile
from ..plans.frames import r, spread, to_long


def documents(spark, sf):
    """The documents, handed out over the cores where the file is a single piece."""
    return spread(table(spark, sf, "documents"), "doc_id")



# ---- text ------------------------------------------------------------------

@query("text_upper", "SELECT doc_id, md5(upper(replace(text, 'ß', 'SS'))) AS digest, CAST(length(text) AS INTEGER) AS n FROM documents")
def text_upper(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.upper(F.col("text"))).alias("digest"), F.length("text").alias("n"))


@query("text_lower", "SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def text_lower(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.lower(F.col("text"))).alias("digest"))


_SPLIT = f"""list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '\\.', ' ', 'g'),
 '[{T.SPACE}]+', ' ', 'g')), ' '), lambda t: t <> '')"""


@query("text_tokenize", f"""SELECT lang, token, count(*) AS n, count(DISTINCT doc_id) AS n_docs
FROM (SELECT doc_id, lang, unnest({_SPLIT}) AS token FROM documents) GROUP BY ALL""")
def text_tokenize(spark, sf):
    tok = documents(spark, sf).select(
        "doc_id", "lang", F.explode(T.simple_tokens(F.col("text"))).alias("token"))
    # count per document first, so that a frequent token is merged before the shuffle on it
    per_doc = tok.groupBy("lang", "token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("lang", "token").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query("text_normalize", f"""SELECT doc_id, md5(trim(regexp_replace(text, '[{T.SPACE}]+', ' ', 'g'))) AS digest
FROM documents""")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@query("text_drop_blank_lines", f"""SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text,
 '\\r\\n|\\r|\\n'), lambda s: regexp_matches(s, '[^{T.SPACE}]')), chr(10))) AS digest FROM documents""")
def text_drop_blank_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.drop_blank_lines(F.col("text"))).alias("digest"))


def _rounded(names):
    return ", ".join(f"round({a}, 6) + 0.0 AS {a}" for a in names)


@query("text_attributes", f"""SELECT doc_id, length_chars, length_words, {_rounded(T.ATTRIBUTES[2:])}
FROM ({text_attributes()})""")
def text_attributes_query(spark, sf):
    d = T.with_text_attributes(documents(spark, sf).select("doc_id", "text", "lang"), "text", F.col("lang"))
    return d.select("doc_id", "length_chars", "length_words", *[r(a).alias(a) for a in T.ATTRIBUTES[2:]])


@query("text_corpus_summary", f"""SELECT count(*) AS n_texts, round(avg(length_chars), 6) AS mean_chars,
 round(avg(length_words), 6) AS mean_words, round(avg(vocab_diversity), 6) AS mean_diversity
FROM ({text_attributes()})""")
def text_corpus_summary(spark, sf):
    d = T.with_text_attributes(documents(spark, sf).select("text", "lang"), "text", F.col("lang"))
    return d.agg(F.count("*").alias("n_texts"), r(F.avg("length_chars")).alias("mean_chars"),
                 r(F.avg("length_words")).alias("mean_words"), r(F.avg("vocab_diversity")).alias("mean_diversity"))


@query("text_line_stats", """SELECT lang, count(*) AS n_lines, round(avg(w), 6) AS mean_words, CAST(max(w) AS INTEGER) AS max_words
FROM (SELECT lang, len(regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+')) AS w
      FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY lang""")
def text_line_stats(spark, sf):
    s = profile.line_stats(documents(spark, sf), "text", ["lang"])
    return s.withColumn("mean_words", r("mean_words"))


@query("word_top20", """SELECT word, count(*) AS n FROM
(SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents)
GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def word_top20(spark, sf):
    return profile.top_words(documents(spark, sf), "text", 20)


# ---- scalars ---------------------------------------------------------------

@query("quality_score", """SELECT p_partkey, round((least(p_size / 100, 1.0) * 0.6
  + greatest(0.0, 1 - (p_retailprice / 4000) / 0.5) * 0.4) * 100, 6) AS service,
 round((least(p_size / 100, 1.0) * 0.6 + greatest(0.0, 1 - (p_retailprice / 4000) / 50) * 0.4) * 100, 6) AS plugin,
 round(p_size / (1 + p_retailprice / 4000), 6) AS plot FROM part""")
def quality_scores(spark, sf):
    p = table(spark, sf, "part")
    sharp, noise = F.col("p_size"), F.col("p_retailprice") / 4000
    return p.select("p_partkey", *[r(quality_score(sharp, noise, v)).alias(v) for v in ("service", "plugin", "plot")])


@query("nan_to_null", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_tax = 0 OR l_discount = 0 AND l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 6) + 0.0 END AS ratio,
 CASE WHEN l_tax = 0 THEN 1 ELSE 0 END + CASE WHEN l_discount = 0 THEN 1 ELSE 0 END AS n_null FROM lineitem""")
def nan_to_null(spark, sf):
    li = table(spark, sf, "lineitem")

    def ieee_ratio(a, b):
        # x / 0 is null in Spark; spell out the floating point result to clean up
        return F.when(b != 0, a / b).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))) \
            .otherwise(F.lit(float("nan")))

    disc, tax = F.col("l_discount"), F.col("l_tax")
    both = finite_array(F.array(ieee_ratio(disc, tax), ieee_ratio(tax, disc)))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     r(finite(ieee_ratio(disc, tax))).alias("ratio"),
                     F.size(F.filter(both, lambda x: x.isNull())).alias("n_null"))


@query("item_id", "SELECT page_id, substr(md5(url), 1, 12) AS item_id FROM pages")
def item_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", item_id(F.col("url")).alias("item_id"))


SPLIT_PATH = "CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'val' WHEN 3 THEN 'test' ELSE 'raw' END"


@query("item_split", f"""SELECT doc_id, CASE WHEN starts_with(p, 'train') THEN 'train' WHEN starts_with(p, 'valid')
 THEN 'valid' WHEN starts_with(p, 'val') THEN 'val' WHEN starts_with(p, 'test') THEN 'test' END AS split
FROM (SELECT doc_id, {SPLIT_PATH} || '/images/' || doc_id || '.txt' AS p FROM documents)""")
def item_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    folder = F.expr(SPLIT_PATH)
    path = F.concat(folder, F.lit("/images/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", split_of_path(path).alias("split"))


# ---- tables ----------------------------------------------------------------

@query("csv_shape_preview", """SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders) AS n_rows,
 6 AS n_columns FROM orders ORDER BY o_orderkey LIMIT 5""")
def csv_shape_preview(spark, sf):
    p = profile.shape_preview(table(spark, sf, "orders"), "o_orderkey", 5)
    return p.select("o_orderkey", "o_custkey", "o_totalprice", "n_rows", "n_columns")


@query("csv_missing_rate", """WITH g AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS id,
 CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status,
 CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_totalprice END AS price, o_orderpriority AS priority FROM orders)
SELECT 'id' AS "column", round(avg(CASE WHEN id IS NULL THEN 1 ELSE 0 END), 4) AS missing_rate FROM g
UNION ALL SELECT 'status', round(avg(CASE WHEN status IS NULL OR status = '' THEN 1 ELSE 0 END), 4) FROM g
UNION ALL SELECT 'price', round(avg(CASE WHEN price IS NULL THEN 1 ELSE 0 END), 4) FROM g
UNION ALL SELECT 'priority', round(avg(CASE WHEN priority IS NULL OR priority = '' THEN 1 ELSE 0 END), 4) FROM g""")
def csv_missing_rate(spark, sf):
    g = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_totalprice") <= 300000, F.col("o_totalprice")).alias("price"),
        F.col("o_orderpriority").alias("priority"))
    return profile.missing_rate(g)


_NUM_SQL = """SELECT attr AS "column", count(*) AS "count", round(avg(value), 4) AS mean,
 round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max,
 round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
 round(quantile_cont(value, 0.75), 4) AS p75, NULL::BIGINT AS "unique", NULL AS top, NULL::BIGINT AS freq
 FROM long GROUP BY attr"""


def _text_sql(col: str, source: str) -> str:
    return (f"""SELECT '{col}', CAST(sum(n) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*),
 min_by(v, ROW(-n, v)), max(n) FROM (SELECT {col} AS v, count(*) AS n FROM {source} GROUP BY 1)""")


_LONG = (f"SELECT attr, value FROM ({unpivot(LINE_COLUMNS, 'lineitem', chr(39) + 'x' + chr(39))})"
         f" UNION ALL SELECT attr, value FROM ({unpivot(['c_acctbal', 'c_nationkey'], 'customer', chr(39) + 'x' + chr(39))})")


@query("csv_describe", f"""WITH long AS ({_LONG}) {_NUM_SQL}
UNION ALL {_text_sql('c_mktsegment', 'customer')} UNION ALL {_text_sql('c_name', 'customer')}
UNION ALL {_text_sql('l_returnflag', 'lineitem')} UNION ALL {_text_sql('l_linestatus', 'lineitem')}""")
def csv_describe(spark, sf):
    li, cu = table(spark, sf, "lineitem"), table(spark, sf, "customer")
    num = profile.describe_numeric(li, LINE_COLUMNS).unionByName(
        profile.describe_numeric(cu, ["c_acctbal", "c_nationkey"]))
    txt = profile.describe_text(cu, ["c_mktsegment", "c_name"]).unionByName(
        profile.describe_text(li, ["l_returnflag", "l_linestatus"]))
    out = num.unionByName(txt, allowMissingColumns=True)
    return out.select("column", "count", *[r(c, 4).alias(c) for c in ("mean", "std")], "min", "max",
                      *[r(c, 4).alias(c) for c in ("p25", "p50", "p75")], "unique", "top", "freq")


SUMMARY_OF_LONG = """SELECT attr, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS min,
 round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
 round(quantile_cont(value, 0.5), 6) AS median FROM long GROUP BY attr"""
_TEXT_ALL = unpivot(T.ATTRIBUTES, f"({text_attributes()})", "'x'")


@query("attr_summary", f"""WITH long AS ({_TEXT_ALL} UNION ALL {unpivot(['p_size', 'p_retailprice'], 'part', "'x'")})
{SUMMARY_OF_LONG}""")
def attr_summary(spark, sf):
    d = T.with_text_attributes(documents(spark, sf).select("text", "lang"), "text", F.col("lang"))
    s = profile.attribute_summary(d, T.ATTRIBUTES).unionByName(
        profile.attribute_summary(table(spark, sf, "part"), ["p_size", "p_retailprice"]))
    return s.select("attr", "n", r("total", 4).alias("total"),
                    *[r(c).alias(c) for c in ("min", "max", "mean", "std", "median")])


@query("resolutions_top10", """SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10""")
def resolutions_top10(spark, sf):
    return profile.top_categories(table(spark, sf, "part"), "p_type", 10)


_SELF_HIST = """WITH long AS ({long}), rng AS (SELECT attr, min(value) AS lo, max(value) AS hi FROM long GROUP BY attr),
c AS (SELECT attr, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * {b}), {b} - 1) END AS bin,
      count(*) AS n FROM long JOIN rng USING (attr) GROUP BY ALL)"""


@query("attr_histogram", _SELF_HIST.format(long=unpivot(LINE_COLUMNS, "lineitem", "'x'"), b=20) + """
SELECT rng.attr, CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) * (g.bin + 0.5) / 20, 4) AS center,
       coalesce(n, 0) AS n
FROM rng CROSS JOIN (SELECT unnest(range(20)) AS bin) g LEFT JOIN c ON c.attr = rng.attr AND c.bin = g.bin""")
def attr_histogram(spark, sf):
    return profile.attribute_histogram(table(spark, sf, "lineitem"), LINE_COLUMNS, 20)


@query("quality_map_sample", """SELECT p_partkey, p_retailprice / 4000 AS noise, p_size AS sharpness FROM part
ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 100""")
def quality_map_sample(spark, sf):
    p = table(spark, sf, "part").withColumn("noise", F.col("p_retailprice") / 4000)
    return profile.quality_map(p, "p_partkey", "noise", "p_size", 100)


@query("categorical_profile", """WITH c AS (SELECT event_type, count(*) AS n FROM
 (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type FROM events) GROUP BY 1),
p AS (SELECT event_type, n, n / (SELECT sum(n) FROM c) AS share FROM c WHERE event_type IS NOT NULL)
SELECT event_type AS value, n, round(share, 6) AS share, (SELECT count(*) FROM p) AS n_distinct,
 (SELECT round(-sum(share * log2(share + 1e-10)), 6) FROM p) AS entropy FROM p""")
def categorical_profile(spark, sf):
    e = table(spark, sf, "events").withColumn(
        "event_type", F.when(F.col("event_id") % 11 != 0, F.col("event_type")))
    return profile.categorical_profile(e, "event_type").select(
        "value", "n", r("share").alias("share"), "n_distinct", r("entropy").alias("entropy"))


@query("numeric_profile", f"""SELECT series, round(mean, 6) AS mean, round(variance, 4) AS variance,
 round(skewness, 5) + 0.0 AS skewness, round(kurtosis, 5) + 0.0 AS kurtosis FROM
(SELECT 'events/' || event_type AS series, {PROFILE_SQL} FROM events GROUP BY event_type UNION ALL
 SELECT 'lineitem/' || l_returnflag, {PROFILE_SQL.replace('value', 'l_quantity')} FROM lineitem GROUP BY l_returnflag)""")
def numeric_profile(spark, sf):
    e = drift.numeric_profile(table(spark, sf, "events"), ["event_type"], "value")
    li = drift.numeric_profile(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    both = e.select(F.concat(F.lit("events/"), "event_type").alias("series"), *drift.MOMENTS).unionByName(
        li.select(F.concat(F.lit("lineitem/"), "l_returnflag").alias("series"), *drift.MOMENTS))
    return both.select("series", r("mean").alias("mean"), r("variance", 4).alias("variance"),
                       r("skewness", 5).alias("skewness"), r("kurtosis", 5).alias("kurtosis"))


@query("hist_entropy", f"""WITH long AS ({unpivot(['l_discount', 'l_tax'], 'lineitem', "'x'")}),
u AS (SELECT attr, least(floor(value * 256), 255) AS bin, count(*) AS n FROM long WHERE value BETWEEN 0 AND 1 GROUP BY ALL),
ue AS (SELECT attr, -sum(p * log2(p)) AS e FROM (SELECT attr, n / sum(n) OVER (PARTITION BY attr) AS p FROM u) GROUP BY attr),
pos AS (SELECT * FROM long WHERE value > 0),
rng AS (SELECT attr, min(value) AS lo, max(value) AS hi FROM pos GROUP BY attr),
d AS (SELECT attr, least(floor((value - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n FROM pos JOIN rng USING (attr) GROUP BY ALL),
de AS (SELECT attr, -sum(p * ln(p)) AS e FROM (SELECT attr, n / sum(n) OVER (PARTITION BY attr) AS p FROM d) GROUP BY attr)
SELECT attr, round(ue.e, 6) AS entropy_bits, round(de.e, 6) AS entropy_positive FROM ue JOIN de USING (attr)""")
def hist_entropy(spark, sf):
    long = to_long(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], ids=())
    bits = profile.unit_histogram_entropy(long).select("attr", r("entropy").alias("entropy_bits"))
    nats = profile.positive_histogram_entropy(long).select("attr", r("entropy").alias("entropy_positive"))
    return bits.join(nats, "attr")


_P = ", ".join(f"quantile_cont(v, {p / 100}) FILTER (v > 0) AS p{p}" for p in profile.PERCENTILES)


@query("distribution_profile", f"""WITH x AS (SELECT l_returnflag, l_discount * l_extendedprice AS v FROM lineitem),
s AS (SELECT l_returnflag, count(v) AS n, count(*) FILTER (v > 0) AS n_positive, avg(v) AS mean, stddev_pop(v) AS std,
 {_P}, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75,
 quantile_cont(v, 0.9) AS threshold_90 FROM x GROUP BY 1),
sk AS (SELECT l_returnflag, {skew('v')} AS skewness
       FROM x WHERE v > 0 GROUP BY 1),
hi AS (SELECT l_returnflag, count(*) FILTER (v > threshold_90) AS n_high FROM x JOIN s USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, n, n_positive, n_high, round(mean, 4) AS mean, round(std, 4) AS std,
 {", ".join(f"round(p{p}, 4) AS p{p}" for p in profile.PERCENTILES)}, round(q25, 4) AS q25, round(q50, 4) AS q50,
 round(q75, 4) AS q75, round(q75 - q25, 4) AS iqr, round(threshold_90, 4) AS threshold_90,
 {", ".join(f"round(p{a} / p{b}, 6) AS p{a}_p{b}" for a, b in profile.RATIOS)},
 round(skewness, 5) AS skewness, round((p90 + p10 - 2 * p50) / (p90 - p10), 6) AS percentile_skewness,
 CASE WHEN abs(skewness) < 0.5 THEN 'symmetric' WHEN skewness > 0.5 THEN 'right_skewed' ELSE 'left_skewed' END AS shape,
 CASE WHEN p95 / p5 > 10 THEN 'high' WHEN p95 / p5 > 5 THEN 'moderate' ELSE 'low' END AS concentration,
 round(n_positive / n * 100, 6) AS activation_ratio
FROM s JOIN sk USING (l_returnflag) JOIN hi USING (l_returnflag)""")
def distribution_profile(spark, sf):
    x = table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_discount") * F.col("l_extendedprice")).alias("v"))
    d = profile.distribution_profile(x, "l_returnflag", "v")
    four = ["mean", "std", *[f"p{p}" for p in profile.PERCENTILES], "q25", "q50", "q75", "iqr", "threshold_90"]
    six = [*[f"p{a}_p{b}" for a, b in profile.RATIOS], "percentile_skewness", "activation_ratio"]
    return d.select("l_returnflag", "n", "n_positive", "n_high", "shape", "concentration",
                    *[r(c, 4).alias(c) for c in four], *[r(c).alias(c) for c in six],
                    r("skewness", 5).alias("skewness"))


@query("result_quality_buckets", """WITH x AS (SELECT (n_chars % 100) / 100 AS o, (n_chars % 37) / 10 AS e, n_chars % 9 AS c, lang
 FROM documents JOIN labels USING (doc_id))
SELECT 'total' AS bucket, count(*) AS n FROM x UNION ALL SELECT 'high_quality', count(*) FROM x WHERE o > 0.5
UNION ALL SELECT 'medium_quality', count(*) FROM x WHERE o > 0.3 AND o <= 0.5
UNION ALL SELECT 'low_quality', count(*) FROM x WHERE o > 0 AND o <= 0.3
UNION ALL SELECT 'no_detection', count(*) FROM x WHERE o <= 0
UNION ALL SELECT 'high_entropy', count(*) FROM x WHERE e > 2 UNION ALL SELECT 'low_entropy', count(*) FROM x WHERE e <= 1
UNION ALL SELECT 'complex_components', count(*) FROM x WHERE c > 5
UNION ALL SELECT 'simple_components', count(*) FROM x WHERE c <= 2
UNION ALL SELECT 'excellent', count(*) FROM x WHERE o > 0.5
UNION ALL SELECT 'good', count(*) FROM x WHERE o > 0.3 AND o <= 0.5
UNION ALL SELECT 'poor', count(*) FROM x WHERE o <= 0.3
UNION ALL SELECT 'class:' || lang, count(*) FROM x GROUP BY lang""")
def result_quality_buckets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang").join(
        table(spark, sf, "labels").select("doc_id"), "doc_id")
    n = F.col("n_chars")
    return profile.quality_buckets(d.select(((n % 100) / 100).alias("overlap"), ((n % 37) / 10).alias("entropy"),
                                            (n % 9).alias("components"), F.col("lang").alias("class_name")))


# ---- files and items -------------------------------------------------------

# paths of eight invented datasets, one per layout, made from the page table
PATH_SQL = """CASE page_id % 8
 WHEN 0 THEN CASE WHEN page_id = 0 THEN 'data.yaml' WHEN page_id % 3 = 0 THEN 'train/images/' || page_id || '.jpg'
   WHEN page_id % 3 = 1 THEN 'train/labels/' || page_id || '.txt' ELSE 'train/images/._' || page_id || '.jpg' END
 WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN 'images/' || page_id || '.png' ELSE 'labels/' || page_id || '.txt' END
 WHEN 2 THEN CASE WHEN page_id % 3 = 0 THEN 'Annotations/' || page_id || '.xml' ELSE 'JPEGImages/' || page_id || '.jpg' END
 WHEN 3 THEN CASE WHEN page_id % 3 = 0 THEN 'annotations/' || page_id || '.json' ELSE 'images/' || page_id || '.jpeg' END
 WHEN 4 THEN CASE WHEN page_id % 3 = 0 THEN '__MACOSX/' || page_id || '.csv' ELSE 'a/' || page_id || '.GIF' END
 WHEN 5 THEN 'tables/' || page_id || '.csv'
 WHEN 6 THEN CASE WHEN page_id % 3 = 0 THEN 'notes/' || page_id || '.md' ELSE page_id || '.mp4' END
 ELSE CASE WHEN page_id % 3 = 0 THEN '.DS_Store' ELSE 'bin/' || page_id || '.bin' END END"""


def page_manifest(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(F.concat(F.lit("ds"), (F.col("page_id") % 8).cast("string")).alias("dataset"),
                    F.expr(PATH_SQL).alias("path"), F.length("html").cast("bigint").alias("size"))


_JUNK = ", ".join(f"'{j}'" for j in [*manifest.JUNK_FOLDERS, *manifest.JUNK_FILES])
MANIFEST_CTE = f"""m AS (SELECT 'ds' || (page_id % 8) AS dataset, {PATH_SQL} AS path, length(html) AS size FROM pages),
f AS (SELECT *, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext FROM m
      WHERE len(list_filter(string_split(path, '/'), lambda p: p IN ({_JUNK}) OR starts_with(p, '._'))) = 0),
k AS (SELECT *, CASE {" ".join(f"WHEN ext IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in manifest.KINDS.items())}
      ELSE 'other' END AS kind FROM f)"""


@query("manifest_stats", f"""WITH {MANIFEST_CTE} SELECT dataset, 'total_files' AS name, count(*) AS n FROM k GROUP BY dataset
UNION ALL SELECT dataset, 'total_size', CAST(sum(size) AS BIGINT) FROM k GROUP BY dataset
UNION ALL SELECT dataset, 'n_folders', count(DISTINCT split_part(path, '/', 1)) FILTER (contains(path, '/')) FROM k GROUP BY dataset
{" ".join(f"UNION ALL SELECT dataset, '{x}_files', count(*) FILTER (kind = '{x}') FROM k GROUP BY dataset" for x in [*manifest.KINDS, 'other'])}
UNION ALL SELECT dataset, 'folder ' || split_part(path, '/', 1), count(*) FROM k WHERE contains(path, '/') GROUP BY ALL""")
def manifest_stats(spark, sf):
    files = page_manifest(spark, sf)
    stats = manifest.manifest_stats(files)
    counts = stats.unpivot(["dataset"], [c for c in stats.columns if c != "dataset"], "name", "n")
    folders = manifest.top_folders(files).select("dataset", F.concat(F.lit("folder "), "folder").alias("name"),
                                                 F.col("n_files").alias("n"))
    return counts.unionByName(folders)


@query("format_detect", f"""WITH {MANIFEST_CTE} SELECT dataset, CASE
 WHEN bool_or(path = 'data.yaml') AND bool_or(path LIKE 'train/%') AND bool_or(path LIKE 'train/images/%')
  AND bool_or(path LIKE 'train/labels/%') AND NOT bool_or(path LIKE 'valid/%') AND NOT bool_or(path LIKE 'test/%') THEN 'roboflow'
 WHEN bool_or(path LIKE 'images/%') AND bool_or(path LIKE 'labels/%') THEN 'yolo'
 WHEN bool_or(regexp_matches(path, '^Annotations/[^/]+\\.xml$')) AND bool_or(regexp_matches(path, '^JPEGImages/[^/]+\\.jpg$')) THEN 'voc'
 WHEN bool_or(path LIKE 'images/%') AND bool_or(regexp_matches(path, '^annotations/[^/]+\\.json$')) THEN 'coco'
 WHEN bool_or(kind = 'csv') THEN 'tabular_bundle' WHEN bool_or(kind = 'text') THEN 'text_bundle'
 WHEN bool_or(kind = 'image') THEN 'image_bundle' ELSE 'unknown' END AS format FROM k GROUP BY dataset""")
def format_detect(spark, sf):
    return manifest.detect_format(page_manifest(spark, sf))


def part_items(spark, sf):
    """The part table as annotated items."""
    k = F.col("p_partkey")
    split = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' WHEN 2 THEN NULL ELSE 'train' END")
    name = F.concat(F.lit("img_"), k.cast("string"), F.lit(".jpg"))
    path = F.concat(F.coalesce(split, F.lit("raw")), F.lit("/images/"), name)
    return table(spark, sf, "part").select(
        k.alias("key"), item_id(path).alias("id"), name.alias("filename"), path.alias("path"), split.alias("split"),
        (k * 1000 + 17).alias("size_bytes"), (F.col("p_size") * 10).alias("width"),
        (F.col("p_size") * 5).alias("height"), F.split("p_name", " ").alias("classes"))


ITEMS_CTE = """it0 AS (SELECT p_partkey AS key, 'img_' || p_partkey || '.jpg' AS filename,
 CASE p_partkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' WHEN 2 THEN NULL ELSE 'train' END AS split,
 p_partkey * 1000 + 17 AS size_bytes, p_size * 10 AS width, p_size * 5 AS height, string_split(p_name, ' ') AS classes
 FROM part), it1 AS (SELECT *, coalesce(split, 'raw') || '/images/' || filename AS path FROM it0),
it AS (SELECT *, substr(md5(path), 1, 12) AS id FROM it1)"""


@query("dataset_stats", f"""WITH {ITEMS_CTE}
SELECT 'split' AS section, coalesce(split, 'unknown') AS name, CAST(count(*) AS DOUBLE) AS value FROM it GROUP BY ALL
UNION ALL SELECT 'class', c, count(*) FROM (SELECT unnest(classes) AS c FROM it) GROUP BY c
UNION ALL SELECT 'total', 'items', count(*) FROM it
UNION ALL SELECT 'total', 'total_mb', round(sum(size_bytes) / 1048576, 6) FROM it
UNION ALL SELECT 'total', 'min_width', min(width) FROM it UNION ALL SELECT 'total', 'max_width', max(width) FROM it
UNION ALL SELECT 'total', 'avg_width', round(avg(width), 6) FROM it
UNION ALL SELECT 'total', 'min_height', min(height) FROM it UNION ALL SELECT 'total', 'max_height', max(height) FROM it
UNION ALL SELECT 'total', 'avg_height', round(avg(height), 6) FROM it""")
def dataset_stats(spark, sf):
    return profile.dataset_stats(part_items(spark, sf)).withColumn("value", r("value"))


@query("class_split_counts", """SELECT l_linestatus AS split, l_returnflag AS class, count(*) AS n_labels,
 count(DISTINCT l_orderkey) AS n_images FROM lineitem GROUP BY ALL""")
def class_split_counts(spark, sf):
    return profile.class_split_counts(table(spark, sf, "lineitem"), "l_linestatus", "l_returnflag", "l_orderkey")
