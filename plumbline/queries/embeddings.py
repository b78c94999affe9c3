"""Embedding drift, ensembles and fusion: labels below 5 against the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from .drift import IMAGE_LONG, IMAGE_NAMES, PROFILE_SQL, TEXT_LONG, image_table, text_pair
from .sqlparts import cdf_ctes, hist_ctes, kl_ctes, psi_ctes, sides, unpivot
from ..functions.scalar import status_label
from ..functions.text import ATTRIBUTES
from ..operators import drift, embedding as E, fusion
from ..plans.frames import one_row, r, split_sides, to_long
from ..plans.scratch import scratch_path
from ..sources import tables
from ..sources.cache import AnalysisCache


def pair(spark, sf):
    e = table(spark, sf, "embeddings")
    return split_sides(e, F.col("label") < 5, F.col("label") >= 5).select(
        "side", F.col("vec_id").alias("key"), "embedding", "label")


EMB = f"""emb AS (SELECT {sides('label < 5')} AS side, vec_id AS key, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
dims AS (SELECT side, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM emb),
mean AS (SELECT d, avg(x) FILTER (side = 'base') AS b, avg(x) FILTER (side = 'target') AS t FROM dims GROUP BY d)"""


@query("emb_mean_shift", f"WITH {EMB} SELECT round(sqrt(sum(pow(b - t, 2))) / sqrt(count(*)), 6) AS mean_shift FROM mean")
def emb_mean_shift(spark, sf):
    return E.mean_distances(pair(spark, sf)).select(r("mean_shift").alias("mean_shift"))


@query("emb_cosine_distance", f"""WITH {EMB}, s AS (SELECT sum(b * t) AS dot, sqrt(sum(b * b)) * sqrt(sum(t * t)) AS len FROM mean)
SELECT round(greatest(1 - dot / len, 0), 6) + 0.0 AS cosine, round(1 - dot / (len + 1e-10), 6) + 0.0 AS cosine_text FROM s""")
def emb_cosine_distance(spark, sf):
    return E.mean_distances(pair(spark, sf)).select(r("cosine").alias("cosine"), r("cosine_text").alias("cosine_text"))


_PROJ = f"SELECT {sides('label < 5')} AS side, 'projection' AS attr, list_sum(CAST(embedding AS DOUBLE[])) / len(embedding) AS value FROM embeddings"


@query("emb_wasserstein_proj", f"WITH {cdf_ctes(_PROJ)} SELECT round(score, 6) + 0.0 AS wasserstein FROM w1")
def emb_wasserstein_proj(spark, sf):
    return E.wasserstein_projected(pair(spark, sf)).select(r("wasserstein").alias("wasserstein"))


def mmd_sql(vectors: str, gammas: list[float], clip: str = "{d}") -> str:
    """CTEs up to ``mmd(gamma, mmd)`` over ``vectors(side, key, v)``."""
    d = clip.format(d="pow(list_distance(a.v, b.v), 2)")
    return f"""vec AS ({vectors}), prs AS (SELECT CASE WHEN a.side = b.side THEN a.side ELSE 'cross' END AS kind, {d} AS d2
 FROM vec a JOIN vec b ON a.key < b.key),
kern AS (SELECT gamma, kind, avg(exp(-gamma * d2)) AS k FROM prs CROSS JOIN (SELECT unnest({gammas}::DOUBLE[]) AS gamma) GROUP BY ALL),
mmd AS (SELECT gamma, sqrt(greatest(sum(CASE kind WHEN 'cross' THEN -2 * k ELSE k END), 0)) AS mmd FROM kern GROUP BY gamma)"""


_VEC = f"SELECT {sides('label < 5')} AS side, vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_STD = """SELECT e.side, e.key, list(e.x0 ORDER BY e.d) AS v FROM (SELECT z.side, z.key, z.d, (z.x - s.m) / (s.sd + 1e-8) AS x0 FROM
 (SELECT side, key, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM emb) z JOIN
 (SELECT side, d, avg(x) AS m, stddev_pop(x) AS sd FROM dims GROUP BY ALL) s ON z.side = s.side AND z.d = s.d) e GROUP BY ALL"""


@query("emb_mmd", f"""WITH {EMB}, {mmd_sql(_VEC, [0.5, 1.0, 2.0])},
{mmd_sql(_STD, [0.01, 1.0], 'least(greatest({d}, -50), 50)').replace('vec AS', 'vec2 AS').replace('vec a', 'vec2 a').replace('vec b', 'vec2 b')
 .replace('prs', 'prs2').replace('kern AS', 'kern2 AS').replace('FROM kern', 'FROM kern2').replace('mmd AS (', 'mmd2 AS (')}
SELECT 'none' AS standardize, gamma, round(mmd, 5) + 0.0 AS mmd FROM mmd UNION ALL
SELECT 'per_set', gamma, round(mmd, 5) + 0.0 FROM mmd2""")
def emb_mmd(spark, sf):
    e = pair(spark, sf)
    plain = E.mmd(e, [0.5, 1.0, 2.0]).select(F.lit("none").alias("standardize"), "gamma", r("mmd", 5).alias("mmd"))
    scaled = E.mmd(e, [0.01, 1.0], standardize="per_set", clip=50.0).select(
        F.lit("per_set").alias("standardize"), "gamma", r("mmd", 5).alias("mmd"))
    return plain.unionByName(scaled)


@query("emb_mmd_multiscale", f"""WITH {mmd_sql(_VEC, E.VISION_GAMMAS)} SELECT 'vision' AS scales, round(avg(mmd), 6) AS mmd_mean,
 round(stddev_pop(mmd), 6) AS mmd_std FROM mmd UNION ALL
SELECT 'text', round(avg(mmd), 6), round(stddev_pop(mmd), 6) FROM mmd WHERE gamma IN (0.5, 1, 2)""")
def emb_mmd_multiscale(spark, sf):
    e = pair(spark, sf)
    known = E.kernels_of_ensembles(e)
    out = [E.mmd_multiscale(e, g, known=known).select(F.lit(n).alias("scales"), r("mmd_mean").alias("mmd_mean"), r("mmd_std").alias("mmd_std"))
           for n, g in (("vision", E.VISION_GAMMAS), ("text", E.TEXT_GAMMAS))]
    return out[0].unionByName(out[1])


@query("emb_mmd_rff")
def emb_mmd_rff(spark, sf):
    return E.mmd_rff(pair(spark, sf), E.TEXT_GAMMAS)


@query("emb_psi_pca")
def emb_psi_pca(spark, sf):
    e = pair(spark, sf)
    variants = {"vision": {"fit_on": "base", "fit_components": 10, "score_components": 5},
                "service": {"fit_on": "base", "fit_components": 5, "score_components": 5},
                "text": {"fit_on": "both", "fit_components": 3, "score_components": 3}}
    out = None
    for name, options in variants.items():
        one = E.psi_pca_row(e, **options).select(F.lit(name).alias("variant"), "psi_mean", "psi_max")
        out = one if out is None else out.unionByName(one)
    return out


@query("emb_pairwise_cosine", f"""WITH v AS ({_VEC}) SELECT round(1 - avg(list_cosine_similarity(a.v, b.v)), 6) + 0.0 AS score
FROM v a JOIN v b ON a.side = 'base' AND b.side = 'target'""")
def emb_pairwise_cosine(spark, sf):
    return E.pairwise_cosine(pair(spark, sf)).select(r("score").alias("score"))


# ---- ensembles and overall scores ------------------------------------------

# The stability index over principal components has no SQL, so the queries with whole rows have none. What the scores are
# made of besides it has: the queries named _rest return that, and "rest" is a score without the index's part.
_MEANS = f"""(WITH {EMB} SELECT sqrt(sum(pow(b - t, 2))) / sqrt(count(*)) AS mean_shift,
 greatest(1 - sum(b * t) / (sqrt(sum(b * b)) * sqrt(sum(t * t))), 0) AS cosine,
 1 - sum(b * t) / (sqrt(sum(b * b)) * sqrt(sum(t * t)) + 1e-10) AS cosine_text FROM mean)"""
_FLOW = f"(WITH {cdf_ctes(_PROJ)} SELECT score AS wasserstein FROM w1)"


def _kernel_row(gammas: list[float]) -> str:
    return f"(WITH {mmd_sql(_VEC, gammas)} SELECT avg(mmd) AS mmd_mean, stddev_pop(mmd) AS mmd_std FROM mmd)"


def _part(metric: str, weight: float, scale: float) -> str:
    return f"{weight} * least({metric} / {scale}, 1)"


def _rest_sql(weights: dict[str, tuple[float, float]]) -> str:
    return " + ".join(_part(m, w, t) for m, (w, t) in weights.items() if m != "psi_mean")


def without_index(weights: dict[str, tuple[float, float]]):
    """The ensemble without its stability index."""
    w, t = weights["psi_mean"]
    return F.col("ensemble") - E.scaled("psi_mean", t) * w


@query("ensemble_vision")
def ensemble_vision(spark, sf):
    return E.ensemble_vision(pair(spark, sf))


@query("ensemble_vision_rest", f"""SELECT round(mmd_mean, 6) AS mmd_mean, round(mmd_std, 6) AS mmd_std, 'exact' AS mmd_method, round(mean_shift, 6) AS mean_shift,
 round(cosine, 6) + 0.0 AS cosine, round(wasserstein, 6) + 0.0 AS wasserstein, round({_rest_sql(E.VISION_WEIGHTS)}, 5) AS rest
FROM {_kernel_row(E.VISION_GAMMAS)}, {_MEANS}, {_FLOW}""")
def ensemble_vision_rest(spark, sf):
    out = E.ensemble_vision(pair(spark, sf)).withColumn("rest", without_index(E.VISION_WEIGHTS))
    return out.select(*[r(c).alias(c) for c in ("mmd_mean", "mmd_std")], "mmd_method",
                      *[r(c).alias(c) for c in ("mean_shift", "cosine", "wasserstein")], r("rest", 5).alias("rest"))


@query("ensemble_text")
def ensemble_text(spark, sf):
    return E.ensemble_text(pair(spark, sf))


@query("ensemble_text_rest", f"""SELECT round(mmd_mean, 6) AS mmd_mean, round(mmd_std, 6) AS mmd_std, 'exact' AS mmd_method, round(cosine_text, 6) + 0.0 AS cosine_text,
 round({_rest_sql(E.TEXT_WEIGHTS)}, 5) AS rest FROM {_kernel_row(E.TEXT_GAMMAS)}, {_MEANS}""")
def ensemble_text_rest(spark, sf):
    out = E.ensemble_text(pair(spark, sf)).withColumn("rest", without_index(E.TEXT_WEIGHTS))
    return out.select(*[r(c).alias(c) for c in ("mmd_mean", "mmd_std")], "mmd_method", r("cosine_text").alias("cosine_text"), r("rest", 5).alias("rest"))


def line_attributes(spark, sf):
    """Lines A against R under the attribute names of the service."""
    li = table(spark, sf, "lineitem")
    li = split_sides(li, F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")
    return to_long(li.select("side", F.col("l_extendedprice").alias("size"), F.col("l_discount").alias("noise"),
                             F.col("l_quantity").alias("sharpness")), ["size", "noise", "sharpness"])


_LINE_KL = f"""(WITH {kl_ctes(unpivot(["size", "noise", "sharpness"], "(SELECT l_returnflag, l_extendedprice AS size, l_discount AS noise, l_quantity AS sharpness FROM lineitem)",
                                      sides("l_returnflag = 'A'"), "l_returnflag IN ('A', 'R')"))}
 SELECT {", ".join(f"round(max(score) FILTER (attr = '{a}'), 4) AS {a}_kl" for a in ("size", "noise", "sharpness"))} FROM kl)"""
_SCALED_KERNEL = f"(WITH {EMB}, {mmd_sql(_STD, [1.0], 'least(greatest({d}, -50), 50)')} SELECT mmd FROM mmd)"
_SERVICE_SQL = f"""SELECT size_kl, noise_kl, sharpness_kl, round(mmd, 5) + 0.0 AS mmd, 'exact' AS mmd_method, round(mean_shift, 6) AS mean_shift,
 round(wasserstein, 6) + 0.0 AS wasserstein, round({_rest_sql(E.SERVICE_WEIGHTS)}, 4) AS rest FROM {_LINE_KL}, {_SCALED_KERNEL}, {_MEANS}, {_FLOW}"""


def _service_columns(row):
    row = row.withColumn("rest", without_index(E.SERVICE_WEIGHTS))
    return row.select("size_kl", "noise_kl", "sharpness_kl", r("mmd", 5).alias("mmd"), "mmd_method", r("mean_shift").alias("mean_shift"),
                      r("wasserstein").alias("wasserstein"), r("rest", 4).alias("rest"), *[c for c in row.columns if c.startswith("has_")])


@query("ensemble_service")
def ensemble_service(spark, sf):
    return E.ensemble_service(E.service_scores(line_attributes(spark, sf), pair(spark, sf)))


@query("ensemble_service_rest", _SERVICE_SQL)
def ensemble_service_rest(spark, sf):
    return _service_columns(E.ensemble_service(E.service_scores(line_attributes(spark, sf), pair(spark, sf))))


def image_overall_row(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    return fusion.image_overall(image_table(spark, sf), pair(spark, sf), p.where("p_partkey % 3 <> 0"),
                                p.where("p_partkey % 5 <> 0"), "p_partkey")


@query("drift_image_overall")
def drift_image_overall(spark, sf):
    return image_overall_row(spark, sf)


@query("drift_image_overall_rest", f"""WITH {psi_ctes(IMAGE_LONG)},
s AS (SELECT n.attr, coalesce(score, 0.0) AS score FROM (VALUES {IMAGE_NAMES}) n(attr) LEFT JOIN psi USING (attr)),
k AS (SELECT p_partkey % 3 <> 0 AS b, p_partkey % 5 <> 0 AS t FROM part)
SELECT round(a, 6) AS attribute_drift, 'exact' AS mmd_method, round(0.45 * a, 6) AS rest, added, removed
FROM (SELECT avg(score) AS a FROM s WHERE attr <> 'size'), (SELECT count(*) FILTER (t AND NOT b) AS added, count(*) FILTER (b AND NOT t) AS removed FROM k)""")
def drift_image_overall_rest(spark, sf):
    out = image_overall_row(spark, sf)
    rest = F.col("overall_score") - 0.55 * F.col("embedding_drift")
    return out.select(r("attribute_drift").alias("attribute_drift"), "mmd_method", r(rest).alias("rest"), "added", "removed")


@query("drift_text_overall")
def drift_text_overall(spark, sf):
    return fusion.text_overall(text_pair(spark, sf), pair(spark, sf))


@query("drift_text_overall_rest", f"""WITH {cdf_ctes(TEXT_LONG)},
m AS (SELECT attr, greatest(abs(avg(value)), 1.0) AS m FROM long WHERE side = 'base' GROUP BY attr),
s AS (SELECT avg(score / m) AS a FROM w1 JOIN m USING (attr)),
e AS (SELECT {_rest_sql(E.TEXT_WEIGHTS)} AS e FROM {_kernel_row(E.TEXT_GAMMAS)}, {_MEANS})
SELECT round(a, 6) AS attribute_drift, 'exact' AS mmd_method, round(e, 5) AS embedding_rest, round(0.5 * a + 0.5 * e, 5) AS overall_rest FROM s, e""")
def drift_text_overall_rest(spark, sf):
    e = pair(spark, sf)
    index = E.psi_pca_row(e, fit_on="both", fit_components=3, score_components=3).select("psi_mean")
    t = one_row(fusion.text_overall(text_pair(spark, sf), e), index)
    w, scale = E.TEXT_WEIGHTS["psi_mean"]
    part = E.scaled("psi_mean", scale) * w
    return t.select(r("attribute_drift").alias("attribute_drift"), "mmd_method", r(F.col("embedding_drift") - part, 5).alias("embedding_rest"),
                    r(F.col("overall_score") - 0.5 * part, 5).alias("overall_rest"))


@query("drift_advanced")
def drift_advanced(spark, sf):
    return fusion.advanced(line_attributes(spark, sf), pair(spark, sf))


@query("drift_advanced_rest", f"SELECT *, true AS has_embeddings, true AS has_attributes FROM ({_SERVICE_SQL})")
def drift_advanced_rest(spark, sf):
    return _service_columns(fusion.advanced(line_attributes(spark, sf), pair(spark, sf)))


@query("drift_detector_select")
def drift_detector_select(spark, sf):
    """Every detector that works on embeddings."""
    e = pair(spark, sf)
    known, out = E.kernels_of_ensembles(e), None
    for modality in ("image", "text"):
        for name in fusion.DETECTORS[modality]:
            one = fusion.embedding_drift(e, modality, name, known=known)
            out = one if out is None else out.unionByName(one)
    return out


# (modality, detector, metric, its SQL, whether a kernel is in it); psi and ensemble detectors have no SQL
_DETECTORS = [("image", "mean_shift", "mean_shift", "mean_shift", False), ("image", "cosine", "cosine", "cosine", False),
              ("image", "wasserstein", "wasserstein", "wasserstein", False), ("text", "cosine", "cosine_text", "cosine_text", False),
              ("text", "mmd_only", "mmd_mean", "t.mmd_mean", True), ("image", "mmd", "mmd_mean", "v.mmd_mean", True)]


@query("drift_detector_select_rest", f"WITH x AS (SELECT *, t.mmd_mean AS text_kernel, v.mmd_mean AS vision_kernel FROM {_kernel_row(E.TEXT_GAMMAS)} t, "
       f"{_kernel_row(E.VISION_GAMMAS)} v, {_MEANS}, {_FLOW})\n" + "\nUNION ALL ".join(
           f"SELECT '{m}' AS modality, '{d}' AS detector, '{k}' AS metric, round({q.replace('t.mmd_mean', 'text_kernel').replace('v.mmd_mean', 'vision_kernel')}, 6) + 0.0 AS embedding_drift, "
           f"{chr(39) + 'exact' + chr(39) if kernel else 'NULL'}::VARCHAR AS mmd_method FROM x" for m, d, k, q, kernel in _DETECTORS))
def drift_detector_select_rest(spark, sf):
    e = pair(spark, sf)
    known, out = E.kernels_of_ensembles(e), None
    for modality, name, *_ in _DETECTORS:
        one = fusion.embedding_drift(e, modality, name, known=known)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("embedding_drift", r("embedding_drift"))


@query("drift_baseline_create", f"""WITH {EMB}, s AS (SELECT sqrt(sum(pow(b - t, 2))) / sqrt(count(*)) AS d FROM mean)
SELECT 1 AS run, 'BASELINE_CREATED' AS status, 0.0::DOUBLE AS overall_score, count(*) AS n_rows FROM embeddings
UNION ALL SELECT 2, CASE WHEN d < 0.15 THEN 'NORMAL' WHEN d < 0.25 THEN 'WARNING' ELSE 'CRITICAL' END, round(d, 6),
 (SELECT count(*) FROM embeddings) FROM s""")
def drift_baseline_create(spark, sf):
    cache = AnalysisCache(spark, scratch_path(spark, "baseline"))
    e = pair(spark, sf)
    first = fusion.drift_or_baseline(e, "s1", "s1", cache, "mean_shift").withColumn("run", F.lit(1))
    second = fusion.drift_or_baseline(e, "s1", "s1", cache, "mean_shift").withColumn("run", F.lit(2))
    return first.unionByName(second).withColumn("overall_score", r("overall_score"))


# ---- fusion ----------------------------------------------------------------

def modality_scores(spark, sf):
    """Per user and event type the mean value as the score of one modality."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("modality")).agg(
        (F.avg("value") / 60).alias("overall_score"),
        F.when(F.sum("value") < 300, "error").otherwise("success").alias("status"))


FUSE = """sc AS (SELECT user_id AS run, event_type AS modality, avg(value) / 60 AS s FROM events GROUP BY ALL HAVING sum(value) >= 300),
n AS (SELECT run, count(*) AS n_modalities FROM sc GROUP BY run)"""


def _fusion_sql(strategy: str, expr: str) -> str:
    ignored = "''" if strategy != "weighted" else """array_to_string(list_filter(['click', 'error', 'video', 'view'],
 lambda w: NOT list_contains(list(modality), w)), ',')"""
    return f"""WITH {FUSE} SELECT run, any_value(n_modalities) AS n_modalities,
 CASE WHEN any_value(n_modalities) >= 2 THEN round({expr}, 9) END AS fused_score, arg_max(modality, s) AS top_modality,
 CASE WHEN any_value(n_modalities) = 1 THEN round(max(s), 9) END AS single_score, '{strategy}' AS strategy, {ignored} AS ignored_weights
FROM sc JOIN n USING (run) GROUP BY run"""


_W = "CASE modality WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.3 WHEN 'error' THEN 0.2 ELSE 0 END"
_FUSION = {
    "weighted": f"CASE WHEN sum({_W}) > 0 THEN sum({_W} * s) / sum({_W}) ELSE avg(s) END",
    "max": "max(s)",
    "joint": "CASE WHEN max(s) >= 1 THEN 1 ELSE 1 - product(1 - least(s, 1)) END",
    "none": "NULL::DOUBLE",
}


def _register(strategy: str) -> None:
    @query(f"fusion_{strategy}", _fusion_sql(strategy, _FUSION[strategy]))
    def run(spark, sf):
        weights = fusion.parse_weights("click=0.5, view=0.3, error=0.2, video=0.9") if strategy == "weighted" else None
        f = fusion.fuse(modality_scores(spark, sf), strategy, weights)
        return f.select("run", "n_modalities", r("fused_score", 9).alias("fused_score"), "top_modality",
                        r("single_score", 9).alias("single_score"), "strategy", "ignored_weights")


for _strategy in _FUSION:
    _register(_strategy)


def _timeline_sql(cut: str) -> str:
    return f"""SELECT '{cut}' AS timestamp, score, 0 AS files_added, 0 AS files_removed FROM (
 WITH p AS (SELECT event_type, ts < TIMESTAMP '{cut}' AS side, {PROFILE_SQL} FROM events GROUP BY ALL),
 l AS (SELECT * FROM p UNPIVOT (v FOR metric IN (mean, variance, skewness, kurtosis))),
 x AS (SELECT event_type, metric, max(v) FILTER (side) AS b, max(v) FILTER (NOT side) AS t FROM l GROUP BY ALL)
 SELECT avg(abs(b - t)) AS score FROM x)"""


@query("sink_timeline", f"""SELECT timestamp, round(score, 4) AS overall_score, files_added, files_removed,
 CASE WHEN score < 0.15 THEN 'NORMAL' WHEN score < 0.25 THEN 'WARNING' ELSE 'CRITICAL' END AS status
FROM ({_timeline_sql('2024-01-10')} UNION ALL {_timeline_sql('2024-01-20')})""")
def sink_timeline(spark, sf):
    from ..sources.sinks import append_timeline
    path = scratch_path(spark, "timeline")
    for cut in ("2024-01-10", "2024-01-20"):
        at = F.to_timestamp(F.lit(cut))
        ev = table(spark, sf, "events").select("ts", "user_id", "event_type", "value")
        scored = drift.moments_drift(split_sides(ev, F.col("ts") < at, F.col("ts") >= at), "event_type")
        append_timeline(scored.select(
            F.lit(cut).alias("timestamp"), F.col("score").alias("overall_score"),
            status_label(F.col("score")).alias("status"), F.lit(0).alias("files_added"), F.lit(0).alias("files_removed")), path)
    back = tables.read_csv(spark, path, "timestamp string, overall_score double, status string, files_added int, files_removed int",
                           sep="\t")
    return back.withColumn("overall_score", r("overall_score", 4)).orderBy("timestamp")


@query("sink_plot_tables", f"""WITH {hist_ctes(TEXT_LONG, 20)}
SELECT 'hist_attributes' AS name, attr AS key, CAST(sum(n_base) AS BIGINT) AS a, CAST(sum(n_target) AS BIGINT) AS b FROM h GROUP BY attr
UNION ALL SELECT 'cluster_sizes', label::VARCHAR, count(*), NULL FROM embeddings GROUP BY label
UNION ALL SELECT 'scatter', side, count(*), count(DISTINCT vec_id) FROM (SELECT {sides('label < 5')} AS side, vec_id FROM embeddings) GROUP BY side""")
def sink_plot_tables(spark, sf):
    from ..operators import cluster
    from ..sources.sinks import write_plot_tables
    path = scratch_path(spark, "plots")
    e = pair(spark, sf)
    coords = cluster.principal_coordinates(e, 2)[0]
    write_plot_tables({
        "hist_attributes": drift.pair_histogram(to_long(text_pair(spark, sf), ATTRIBUTES)),
        "cluster_sizes": e.groupBy("label").agg(F.count("*").alias("size")),
        "scatter": coords.join(e.select("key", "side", "label"), "key")}, path)
    read = {name: spark.read.option("header", True).csv(f"{path}/{name}") for name in ("hist_attributes", "cluster_sizes", "scatter")}
    # every point of the scatter table has both coordinates
    points = read["scatter"].where("cast(c1 AS double) IS NOT NULL AND cast(c2 AS double) IS NOT NULL")
    parts = [read["hist_attributes"].groupBy(F.col("attr").alias("key")).agg(F.sum(F.col("n_base").cast("bigint")).alias("a"), F.sum(F.col("n_target").cast("bigint")).alias("b")),
             read["cluster_sizes"].select(F.col("label").alias("key"), F.col("size").cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b")),
             points.groupBy(F.col("side").alias("key")).agg(F.count("*").alias("a"), F.count_distinct("key").alias("b"))]
    out = [df.withColumn("name", F.lit(name)) for name, df in zip(read, parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])
