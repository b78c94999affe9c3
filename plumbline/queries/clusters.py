"""Clusters of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from ..functions import vectors as V
from ..operators import cluster, linkage
from ..plans.frames import r
from ..plans.scratch import cut


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


def coords2(spark, sf):
    return cluster.principal_coordinates(embeddings(spark, sf), 2)[0]


def _pca(spark, sf, k):
    coords, _, ratio = cluster.principal_coordinates(embeddings(spark, sf), k)
    return coords.select("key", *[r(c).alias(c) for c in coords.columns[1:]],
                         *[F.lit(round(v, 6)).alias(f"explained_{i + 1}") for i, v in enumerate(ratio)])


@query("emb_pca2d")
def emb_pca2d(spark, sf):
    return _pca(spark, sf, 2)


@query("emb_pca3d")
def emb_pca3d(spark, sf):
    return _pca(spark, sf, 3)


@query("cluster_kmeans")
def cluster_kmeans(spark, sf):
    return cluster.kmeans(coords2(spark, sf), k=10)


@query("cluster_select_silhouette")
def cluster_select_silhouette(spark, sf):
    features = cluster.assembled(cut(coords2(spark, sf)))
    rows = cluster.silhouette_table(features)
    best = cluster.best_silhouette_k(rows, features.count())
    t = spark.createDataFrame(rows, "k int, silhouette double, calinski_harabasz double")
    return t.withColumn("quality", cluster.silhouette_quality(F.col("silhouette"))).withColumn("chosen", F.col("k") == best)


@query("cluster_select_elbow")
def cluster_select_elbow(spark, sf):
    features = cluster.assembled(cut(coords2(spark, sf)))
    costs = cluster.elbow_table(features)
    best = cluster.elbow_k(costs, features.count())
    rows = [(k, c, None if i == 0 else (costs[i - 1][1] - c) / costs[i - 1][1] * 100) for i, (k, c) in enumerate(costs)]
    return spark.createDataFrame(rows, "k int, cost double, reduction_percent double").withColumn("chosen", F.col("k") == best)


@query("cluster_select_rule", """SELECT label, count(*) AS n, CASE WHEN count(*) < 5 THEN 1 WHEN count(*) < 10 THEN 2 WHEN count(*) < 20 THEN 3
 WHEN count(*) < 50 THEN 4 WHEN count(*) < 100 THEN 5 ELSE least(8, count(*) // 20) END::INTEGER AS k FROM embeddings GROUP BY label
UNION ALL SELECT -1, count(*), CASE WHEN count(*) < 100 THEN 5 ELSE least(8, count(*) // 20) END::INTEGER FROM embeddings""")
def cluster_select_rule(spark, sf):
    e = embeddings(spark, sf)
    n = F.count("*")
    return e.groupBy("label").agg(n.alias("n"), cluster.rule_k(n).alias("k")).unionByName(
        e.agg(F.lit(-1).alias("label"), n.alias("n"), cluster.rule_k(n).alias("k")))


# brute force: all pairs, then the components of the core points
DBSCAN = """p AS (SELECT vec_id AS key, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
nb AS MATERIALIZED (SELECT a.key AS a, b.key AS b FROM p a JOIN p b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {eps} * {eps}),
core AS MATERIALIZED (SELECT a AS key FROM nb GROUP BY a HAVING count(*) >= 5),
cn AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT key AS root, key FROM core UNION SELECT root, b FROM reach JOIN cn ON cn.a = reach.key),
cl AS (SELECT key, min(root) AS cluster FROM reach GROUP BY key),
bd AS (SELECT nb.a AS key, min(cluster) AS cluster FROM nb JOIN cl ON cl.key = nb.b WHERE nb.a NOT IN (FROM core) GROUP BY 1)
SELECT p.key, coalesce(cl.cluster, bd.cluster, -1) AS cluster,
 CASE WHEN cl.key IS NOT NULL THEN 'core' WHEN bd.key IS NOT NULL THEN 'border' ELSE 'noise' END AS kind
FROM p LEFT JOIN cl USING (key) LEFT JOIN bd USING (key)"""


@query("cluster_dbscan", f"WITH RECURSIVE {DBSCAN.format(eps=0.02)}")
def cluster_dbscan(spark, sf):
    points = embeddings(spark, sf).select("key", F.get("embedding", F.lit(0)).cast("double").alias("x"),
                                          F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return cluster.dbscan(points, 0.02, 5).select("key", "cluster", "kind")


@query("cluster_hierarchical")
def cluster_hierarchical(spark, sf):
    return cluster.hierarchical(coords2(spark, sf))


# brute force: the spanning tree grown place by place, then the components of its shortest links
LINKAGE = """WITH RECURSIVE p AS (SELECT vec_id AS key, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
grow AS (SELECT 1 AS step, o.key, o.x, o.y, {'d2': (o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y), 'p': f.key, 'q': o.key} AS link
 FROM p o, (SELECT * FROM p ORDER BY key LIMIT 1) f WHERE o.key <> f.key
 UNION ALL SELECT step + 1, key, x, y, CASE WHEN new < link THEN new ELSE link END FROM (SELECT w.*,
  {'d2': (w.x - m.x) * (w.x - m.x) + (w.y - m.y) * (w.y - m.y), 'p': least(w.key, m.key), 'q': greatest(w.key, m.key)} AS new
  FROM grow w, (SELECT key, x, y FROM grow ORDER BY link LIMIT 1) m WHERE w.key <> m.key)),
tree AS MATERIALIZED (SELECT min(link) AS link FROM grow GROUP BY step),
kept AS MATERIALIZED (SELECT link.p AS a, link.q AS b FROM tree ORDER BY link LIMIT (SELECT count(*) - least(5, count(*) // 2) FROM p)),
both_ways AS MATERIALIZED (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept),
reach AS (SELECT key AS root, key FROM p UNION SELECT root, b FROM reach JOIN both_ways ON a = reach.key)
SELECT key, min(root) AS cluster FROM reach GROUP BY key"""


@query("cluster_single_linkage", LINKAGE)
def cluster_single_linkage(spark, sf):
    points = embeddings(spark, sf).select("key", F.get("embedding", F.lit(0)).cast("double").alias("x"),
                                          F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return linkage.single_linkage(points).select("key", "cluster")


COSINE = """x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
s AS (SELECT label, d, sum(v) AS s, count(*) AS n FROM x GROUP BY ALL),
w AS (SELECT vec_id, label, (sum(v * s) - sum(v * v)) / any_value(n) AS weight FROM x JOIN s USING (label, d) GROUP BY ALL),
c AS (SELECT label, d, sum(v * weight) / sum(weight) AS c FROM x JOIN w USING (vec_id, label) GROUP BY ALL),
sim AS (SELECT vec_id AS key, label, any_value(weight) AS weight, least(greatest(sum(v * c), -1), 1) AS similarity
 FROM x JOIN c USING (label, d) JOIN w USING (vec_id, label) GROUP BY ALL)"""


def similar(spark, sf):
    return cluster.cosine_centroids(embeddings(spark, sf), "label", "key")


@query("cluster_centroids_cosine", f"WITH {COSINE} SELECT key, label, round(weight, 6) + 0.0 AS weight, round(similarity, 6) + 0.0 AS similarity FROM sim")
def cluster_centroids_cosine(spark, sf):
    return similar(spark, sf).select("key", "label", r("weight").alias("weight"), r("similarity").alias("similarity"))


@query("cluster_centroids_2d", """WITH p AS (SELECT vec_id AS key, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
w AS (SELECT a.key, a.label, any_value(a.x) AS x, any_value(a.y) AS y, sum(1 / (sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) + 1e-8)) AS weight
 FROM p a JOIN p b ON a.label = b.label AND a.key <> b.key GROUP BY ALL),
c AS (SELECT label, sum(weight * x) / sum(weight) AS mx, sum(weight * y) / sum(weight) AS my FROM w GROUP BY 1),
d AS (SELECT *, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS distance FROM w JOIN c USING (label)),
s AS (SELECT label, stddev_pop(distance) AS sd FROM d GROUP BY 1)
SELECT key, label, round(weight, 3) AS weight, round(distance, 6) AS distance, round(exp(-distance / sd), 6) AS similarity FROM d JOIN s USING (label)""")
def cluster_centroids_2d(spark, sf):
    points = embeddings(spark, sf).select("key", "label", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    c = cluster.centroids_2d(points, "label", "key")
    return c.select("key", "label", r("weight", 3).alias("weight"), r("distance").alias("distance"), r("similarity").alias("similarity"))


@query("cluster_stats", f"""WITH {COSINE} SELECT label, count(*) AS size, round(avg(similarity), 6) + 0.0 AS avg_similarity,
 round(min(similarity), 6) + 0.0 AS min_similarity, round(max(similarity), 6) + 0.0 AS max_similarity FROM sim GROUP BY label""")
def cluster_stats(spark, sf):
    s = cluster.cluster_stats(similar(spark, sf), "label")
    return s.select("label", "size", *[r(c).alias(c) for c in s.columns[2:]])


@query("top5_per_cluster", f"""WITH {COSINE} SELECT label, key, CAST(rank AS INTEGER) AS rank, round(similarity, 6) + 0.0 AS similarity FROM
 (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, key) AS rank FROM sim) WHERE rank <= 5""")
def top5_per_cluster(spark, sf):
    return cluster.top_members(similar(spark, sf), "label", "key").select("label", "key", "rank", r("similarity").alias("similarity"))


@query("cluster_sizes", "SELECT label, count(*) AS size FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf):
    return embeddings(spark, sf).groupBy("label").agg(F.count("*").alias("size"))


@query("emb_cosine", """SELECT a.vec_id AS key, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def emb_cosine(spark, sf):
    e = embeddings(spark, sf)
    after = e.select((F.col("key") - 1).alias("key"), F.col("embedding").alias("next"))
    return e.join(after, "key").select("key", r(V.cosine(F.col("embedding"), F.col("next"))).alias("cosine"))


# ---- on the projected coordinates ------------------------------------------

@query("cluster_dbscan_projected")
def cluster_dbscan_projected(spark, sf):
    points = coords2(spark, sf).select("key", F.col("c1").alias("x"), F.col("c2").alias("y"))
    return cluster.dbscan(points, 0.02, 5).select("key", "cluster", "kind")


@query("cluster_centroids_projected")
def cluster_centroids_projected(spark, sf):
    points = coords2(spark, sf).join(embeddings(spark, sf).select("key", "label"), "key").select(
        "key", "label", F.col("c1").alias("x"), F.col("c2").alias("y"))
    return cluster.centroids_2d(points, "label", "key")


@query("cluster_chain")
def cluster_chain(spark, sf):
    """Coordinates, k-means on them, centroids and similarities, statistics and the five most similar of each cluster."""
    coords = cut(coords2(spark, sf))
    found = cut(cluster.kmeans(coords, k=10).select("key", "cluster"))
    points = coords.join(found, "key").select("key", "cluster", F.col("c1").alias("x"), F.col("c2").alias("y"))
    similar = cut(cluster.centroids_2d(points, "cluster", "key"))
    stats = cluster.cluster_stats(similar, "cluster")
    return cluster.top_members(similar, "cluster", "key").select("cluster", "key", "rank", "similarity").join(stats, "cluster")
