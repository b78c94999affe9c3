"""Comparisons of table versions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from .drift import SUMMARY_SQL, orders_by_year
from .sqlparts import text_attributes
from ..functions import text as T
from ..operators import compare, envelopes, snapshots
from ..plans.frames import r, split_sides
from ..plans.scratch import scratch_path


@query("files_added_removed", """WITH b AS (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0),
c AS (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0)
SELECT (SELECT count(*) FROM c WHERE p_partkey NOT IN (FROM b)) AS added,
 (SELECT count(*) FROM b WHERE p_partkey NOT IN (FROM c)) AS removed,
 (SELECT count(*) FROM b WHERE p_partkey IN (FROM c)) AS common""")
def files_added_removed(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    return compare.added_removed(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 5 <> 0"), "p_partkey")


def order_manifests(spark, sf):
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderkey",
        F.floor("o_totalprice").alias("size"), F.unix_timestamp("o_orderdate").cast("double").alias("mtime"))
    cached = o.where("o_orderkey % 10 <> 1").select("path", "size", "mtime")
    k = F.col("o_orderkey")
    current = o.where("o_orderkey % 10 <> 2").select(
        "path", F.when(k % 10 == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(k % 10 == 4, F.col("mtime") + 5.0).when(k % 10 == 5, F.col("mtime") + 0.5)
        .otherwise(F.col("mtime")).alias("mtime"))
    return cached, current


@query("incremental_changes", """SELECT 'o/' || o_orderkey AS path, CASE o_orderkey % 10 WHEN 1 THEN 'new' WHEN 2 THEN 'removed'
 WHEN 3 THEN 'modified' WHEN 4 THEN 'modified' ELSE 'unchanged' END AS state FROM orders""")
def incremental_changes(spark, sf):
    return compare.incremental_changes(*order_manifests(spark, sf))


@query("incremental_refresh", f"""SELECT doc_id, length_chars, length_words, round(vocab_diversity, 6) AS vocab_diversity,
 doc_id % 5 IN (0, 1) AS recomputed FROM ({text_attributes()}) WHERE doc_id % 5 <> 2""")
def incremental_refresh(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")

    def compute(df):
        return T.with_text_attributes(df, "text", F.col("lang")).drop("text", "lang")

    k = F.col("doc_id")
    manifest = docs.select(k.alias("path"), F.length("text").alias("size"), F.lit(0.0).alias("mtime"))
    before = manifest.where(k % 5 != 0).withColumn(
        "size", F.when(F.col("path") % 5 == 1, F.col("size") + 1).otherwise(F.col("size")))
    changes = compare.incremental_changes(before, manifest.where(F.col("path") % 5 != 2)) \
        .withColumnRenamed("path", "doc_id")
    cached = compute(docs.where(k % 5 != 0))
    out = compare.incremental_refresh(cached, docs.where(k % 5 != 2), changes, "doc_id", compute)
    return out.select("doc_id", "length_chars", "length_words", r("vocab_diversity").alias("vocab_diversity"), "recomputed")


def lines_by_date(spark, sf):
    """Lines 1-5 before 1998 against lines 3-7 from then on."""
    early = (F.col("l_shipdate") < "1998-01-01") & (F.col("l_linenumber") <= 5)
    late = (F.col("l_shipdate") >= "1998-01-01") & (F.col("l_linenumber") >= 3)
    df = table(spark, sf, "lineitem").select("l_shipdate", "l_linenumber", "l_returnflag", "l_linestatus")
    return split_sides(df, early, late)


_BY_DATE = """x AS (SELECT *, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'base' ELSE 'target' END AS side FROM lineitem
 WHERE (l_shipdate < TIMESTAMP '1998-01-01' AND l_linenumber <= 5) OR (l_shipdate >= TIMESTAMP '1998-01-01' AND l_linenumber >= 3))"""


def _count_sql(expr, name):
    return f"""WITH {_BY_DATE}, c AS (SELECT {expr} AS {name}, count(*) FILTER (side = 'base') AS base,
 count(*) FILTER (side = 'target') AS target FROM x GROUP BY 1) SELECT *, target - base AS delta FROM c"""


@query("class_drift", _count_sql("l_returnflag || '-' || l_linenumber", "class"))
def class_drift(spark, sf):
    return compare.count_drift(lines_by_date(spark, sf), F.concat_ws("-", "l_returnflag", "l_linenumber"), "class")


@query("split_drift", _count_sql("l_linestatus", "split"))
def split_drift(spark, sf):
    return compare.count_drift(lines_by_date(spark, sf), F.col("l_linestatus"), "split")


@query("stats_diff", f"""WITH a AS ({SUMMARY_SQL.format(y=1996)} UNION ALL SELECT 'only_left', 3.0),
b AS ({SUMMARY_SQL.format(y=1997)} UNION ALL SELECT 'only_right', 5.0)
SELECT key, round(coalesce(b.value, 0) - coalesce(a.value, 0), 4) + 0.0 AS diff FROM a FULL JOIN b USING (key) ORDER BY key""")
def stats_diff(spark, sf):
    s = orders_by_year(spark, sf).where("year IN (1996, 1997)")
    def extra(key, v):
        return spark.range(1).select(F.lit(key).alias("key"), F.lit(v).alias("value"))
    left = s.where("year = 1996").select("key", "value").unionByName(extra("only_left", 3.0))
    right = s.where("year = 1997").select("key", "value").unionByName(extra("only_right", 5.0))
    return compare.stats_diff(left, right).withColumn("diff", r("diff", 4))


@query("snapshot_row_diff", """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'removed'
 WHEN 2 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'same' ELSE 'changed' END ELSE 'same' END AS state FROM customer""")
def snapshot_row_diff(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    new = c.where(k % 7 != 1).withColumn(
        "c_mktsegment", F.when(k % 7 == 2, "BUILDING").otherwise(F.col("c_mktsegment")))
    return compare.row_diff(c.where(k % 7 != 0), new, "c_custkey")


def order_snapshots(spark, sf):
    """A store with three snapshots of the orders: ``a``, then ``b`` by an upsert, then ``c`` of all rows as they are."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    store = scratch_path(spark, "snapshots")
    snapshots.commit(o.where("o_orderkey % 97 <> 2"), "o_orderkey", store, "a", 64)
    changes = o.where("o_orderkey % 97 IN (1, 2)").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 1, None).otherwise(F.col("o_orderstatus")))
    snapshots.upsert(spark, store, "a", "b", changes, o.where("o_orderkey % 97 = 0"))
    snapshots.commit(o, "o_orderkey", store, "c", 64)
    return store


@query("snapshot_upsert", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 <> 1 THEN o_orderstatus END AS o_orderstatus, o_totalprice
FROM orders WHERE o_orderkey % 97 <> 0""")
def snapshot_upsert(spark, sf):
    return snapshots.read(spark, order_snapshots(spark, sf), "b").drop("o_orderdate")


@query("snapshot_tree_diff", """SELECT o_orderkey, CASE o_orderkey % 97 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' ELSE 'added' END AS state
FROM orders WHERE o_orderkey % 97 IN (0, 2) OR (o_orderkey % 97 = 1 AND o_orderstatus IS NOT NULL)""")
def snapshot_tree_diff(spark, sf):
    return snapshots.diff(spark, order_snapshots(spark, sf), "a", "b")


@query("snapshot_verify_all", """SELECT version, n_rows, 0::BIGINT AS n_changed, 0::BIGINT AS n_missing, true AS tree_ok, true AS valid FROM (
SELECT 'a' AS version, count(*) AS n_rows FROM orders WHERE o_orderkey % 97 <> 2 UNION ALL
SELECT 'b', count(*) FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT 'c', count(*) FROM orders)""")
def snapshot_verify_all(spark, sf):
    return snapshots.verify(spark, order_snapshots(spark, sf)).drop("n_buckets")


def label_views(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.where("quality = 1").select(F.lit("good").alias("name"), "doc_id").unionByName(
        lab.where("toxic = 1").select(F.lit("toxic").alias("name"), "doc_id"))


@query("view_keep_only", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def view_keep_only(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return compare.apply_view(d, label_views(spark, sf), "good", "keep_only", "doc_id")


@query("view_remove", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def view_remove(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return compare.apply_view(d, label_views(spark, sf), "toxic", "remove", "doc_id")


@query("view_preview", """WITH g AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT doc_id, (SELECT count(*) FROM g) AS to_remove, (SELECT count(*) FROM documents) - (SELECT count(*) FROM g) AS to_keep
FROM g ORDER BY doc_id LIMIT 10""")
def view_preview(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return compare.preview_view(d, label_views(spark, sf), "toxic", "remove", "doc_id")


@query("duplicate_registrations", """WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url),
 '^[a-z]+://(www\\.|m\\.)?', ''), '[?#].*$', ''), '/+$', '') AS norm_path FROM pages)
SELECT norm_path, page_id, first_key FROM n JOIN (SELECT norm_path, min(page_id) AS first_key FROM n GROUP BY 1) USING (norm_path)
WHERE page_id <> first_key""")
def duplicate_registrations(spark, sf):
    return compare.duplicate_registrations(table(spark, sf, "pages"), "page_id", "url")


@query("representative_sort_union", """SELECT side, p_partkey, attr, value FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'base' ELSE 'target' END
 AS side, p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR attr IN (p_size, p_retailprice))""")
def representative_sort_union(spark, sf):
    p = table(spark, sf, "part")
    return compare.stacked(p.where("p_partkey % 3 = 0"), p.where("p_partkey % 3 <> 0"),
                           ["p_size", "p_retailprice"], "p_partkey")


def event_results(spark, sf):
    """Events as drift results: user -> base, event type -> target, value -> score."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("base_id"), F.col("event_type").alias("target_id"),
        (F.col("value") / 500).alias("overall"), F.col("ts").alias("created_at"))


@query("drift_result_upsert", """SELECT user_id AS base_id, event_type AS target_id, arg_max(value / 500, ts) AS overall,
 max(ts) AS created_at FROM events GROUP BY ALL""")
def drift_result_upsert(spark, sf):
    e = event_results(spark, sf)
    cut = F.to_timestamp(F.lit("2024-01-16"))
    return compare.upsert_results(e.where(F.col("created_at") < cut), e.where(F.col("created_at") >= cut))


# results in four shapes, made from the events
RESULT_JSON = """CASE event_id % 5
 WHEN 0 THEN concat('{"advanced_drift":{"ensemble":{"overall_score":', v, '}}}')
 WHEN 1 THEN concat('{"ensemble":{"overall_score":', v, '}}')
 WHEN 2 THEN concat('{"modalities":{"text":{"status":"error"},"image":{"ensemble":{"overall_score":', v, '}}}}')
 WHEN 3 THEN concat('{"modality":"text","overall_score":', v, '}')
 ELSE '{"status":"error"}' END"""


@query("extract_overall_score", """SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(CAST(floor(value) AS INTEGER) AS DOUBLE) END
 AS overall FROM events""")
def extract_overall_score(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor("value").cast("int").cast("string").alias("v"))
    return e.select("event_id", compare.overall_score(F.expr(RESULT_JSON)).alias("overall"))


@query("envelope_classify", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'eda' WHEN 1 THEN 'eda' WHEN 2 THEN 'multi_modal'
 ELSE 'drift' END AS kind FROM events""")
def envelope_classify(spark, sf):
    payload = F.expr("""CASE event_id % 5
      WHEN 0 THEN concat('{"modality":"text","texts_analyzed":', event_id, '}')
      WHEN 1 THEN concat('{"modality":"image","summary":{"n":', event_id, '}}')
      WHEN 2 THEN '{"modalities":{"text":{"overall_score":0.1}},"summary":{}}'
      WHEN 3 THEN concat('{"modality":"text","summary":{},"overall_score":', value, '}')
      ELSE concat('{"modality":"text","attribute_drifts":{"x":', value, '}}') END""")
    return table(spark, sf, "events").select("event_id", envelopes.classify(payload).alias("kind"))


@query("drift_envelope", """SELECT event_id AS snapshot_id, coalesce(CASE WHEN event_id % 4 = 0 THEN 'NORMAL' END,
 CASE WHEN o >= 0.25 THEN 'critical' WHEN o >= 0.15 THEN 'warning' ELSE 'normal' END) AS severity, round(o, 6) AS overall,
 '1.0' AS protocol, 'events' AS app_id, round(o, 6) AS json_overall FROM
 (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value / 500 END AS o FROM events)""")
def drift_envelope(spark, sf):
    k = F.col("event_id")
    results = table(spark, sf, "events").select(
        k.alias("snapshot_id"), F.lit("timeseries").alias("modality"), F.col("event_type").alias("model_name"),
        F.when(k % 9 != 0, F.col("value") / 500).alias("overall_score"), F.when(k % 4 == 0, "NORMAL").alias("status"))
    env = envelopes.drift_envelope(results, "events")
    j = F.col("envelope")
    return env.select("snapshot_id", "severity", r("overall").alias("overall"),
                      F.get_json_object(j, "$.protocol_version").alias("protocol"),
                      F.get_json_object(j, "$.source.app_id").alias("app_id"),
                      r(F.get_json_object(j, "$.drift.scores.overall").cast("double")).alias("json_overall"))
