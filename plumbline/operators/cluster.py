"""Clusters of embeddings: coordinates, algorithms, choice of k, centroids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from ..plans.components import connected_components
from ..plans.frames import grouped, join_few, with_scalars
from ..plans.scratch import cut

# rows of a block, and of the strips in which a task works through a pair of blocks
TILE_ROWS = 16_384
STRIP_ROWS = 2048
# columns of a strip that are worked through at a time, 4 MB of distances
COLUMNS = 256


# ---- coordinates -----------------------------------------------------------

def principal_coordinates(df: DataFrame, k: int, key: str = "key", column: str = "embedding"):
    """(key, c1..ck) centred coordinates, the components (one array per axis) and explained variance.

    The sign of each axis is fixed so that its largest loading is positive.
    """
    v = df.select(key, array_to_vector(F.col(column)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(v)
    loadings = model.pc.toArray()
    signs = [1.0 if axis[np.argmax(np.abs(axis))] >= 0 else -1.0 for axis in loadings.T]
    p = model.transform(v).select(key, vector_to_array("p").alias("p"))
    names = [f"c{i + 1}" for i in range(k)]
    raw = p.select(key, *[(F.get("p", F.lit(i)) * signs[i]).alias(n) for i, n in enumerate(names)])
    means = raw.agg(*[F.avg(n).alias(f"m_{n}") for n in names])
    centred = with_scalars(raw, means).select(key, *[(F.col(n) - F.col(f"m_{n}")).alias(n) for n in names])
    return centred, (loadings * signs).T.tolist(), model.explainedVariance.toArray().tolist()


def assembled(coords: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[c for c in coords.columns if c.startswith("c")], outputCol="features").transform(coords)


# ---- algorithms ------------------------------------------------------------

# Fixed values of the next two: the rule for the number of clusters, and the one where no selection works.
def rule_k(n: Column) -> Column:
    """Number of clusters by the number of rows."""
    return (F.when(n < 5, 1).when(n < 10, 2).when(n < 20, 3).when(n < 50, 4).when(n < 100, 5)
            .otherwise(F.least(F.lit(8), F.floor(n / 20)))).cast("int")


def fallback_k(n: int) -> int:
    return 1 if n < 10 else 2 if n < 20 else min(4, n // 5)


def silhouette_table(features: DataFrame, seed: int = 42) -> list[tuple[int, float, float]]:
    """(k, silhouette, Calinski-Harabasz) for k in 2..min(10, n - 1); one distributed fit per k.

    The silhouette is the squared Euclidean one of Spark, which needs no pairs.
    """
    n = features.count()
    spread = features.agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in features.columns if c.startswith("c")]).first()
    total = sum(spread)
    out = []
    for k in range(2, min(10, n - 1) + 1):
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
        score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(model.transform(features))
        within = model.summary.trainingCost
        ch = ((total - within) / (k - 1)) / (within / (n - k)) if within > 0 and n > k else 0.0
        out.append((k, score, ch))
    return out


def best_silhouette_k(table: list[tuple[int, float, float]], n: int) -> int:
    if n - 1 < 2:
        return 1
    best = max(table, key=lambda row: row[1])
    return best[0] if best[1] > 0 else fallback_k(n)


# The bounds of each grade.
def silhouette_quality(score: Column) -> Column:
    return F.when(score >= 0.7, "Strong").when(score >= 0.5, "Reasonable").when(score >= 0.25, "Weak").otherwise("Poor")


def elbow_table(features: DataFrame, seed: int = 42) -> list[tuple[int, float]]:
    """(k, within-cluster sum of squares) for k in 1..min(10, n)."""
    n = features.count()
    out = []
    for k in range(1, min(10, n) + 1):
        if k == 1:
            spread = features.agg(*[(F.var_pop(c) * F.count(c)) for c in features.columns if c.startswith("c")]).first()
            out.append((1, float(sum(spread))))
        else:
            out.append((k, KMeans(k=k, seed=seed, featuresCol="features").fit(features).summary.trainingCost))
    return out


def elbow_k(costs: list[tuple[int, float]], n: int) -> int:
    """The k farthest below the chord from the first to the last cost."""
    if len(costs) < 3:
        return fallback_k(n)
    ks, ws = np.array([c[0] for c in costs], float), np.array([c[1] for c in costs], float)
    if ws[0] <= ws[-1]:
        return fallback_k(n)
    x, y = (ks - ks[0]) / (ks[-1] - ks[0]), (ws - ws[-1]) / (ws[0] - ws[-1])
    gap = 1 - x - y
    return int(ks[np.argmax(gap)]) if gap.max() > 0 else fallback_k(n)


def kmeans(coords: DataFrame, k: int | None = None, select: str = "silhouette", seed: int = 42) -> DataFrame:
    """Coordinates with ``cluster``; k given or chosen by silhouette, elbow or row count."""
    features = assembled(cut(coords))
    if k is None:
        n = features.count()
        if select == "elbow":
            k = elbow_k(elbow_table(features, seed), n)
        elif select == "manual":
            k = features.agg(rule_k(F.count("*"))).first()[0]
        else:
            k = best_silhouette_k(silhouette_table(features, seed), n)
    if k < 2:
        return coords.withColumn("cluster", F.lit(0))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
    return model.transform(features).drop("features")


def hierarchical(coords: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """Hierarchy from the top by bisecting k-means; default k = min(5, n // 2).

    Joining pairs from the bottom needs all distances; splitting from the top does not.
    """
    features = assembled(cut(coords))
    k = k or min(5, features.count() // 2)
    if k < 2:
        return coords.withColumn("cluster", F.lit(0))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
    return model.transform(features).drop("features")


# ---- density clusters ------------------------------------------------------

def _near(eps: float, a: str, b: str) -> Column:
    return F.pow(F.col(f"{a}x") - F.col(f"{b}x"), 2) + F.pow(F.col(f"{a}y") - F.col(f"{b}y"), 2) <= eps * eps


_OFFSETS = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)
            if (dx, dy) != (0, 0) and abs(dx) + abs(dy) < 4]


def _neighbour_cells(df: DataFrame, half: bool = False) -> DataFrame:
    offsets = [o for o in _OFFSETS if not half or o > (0, 0)]
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    return (df.withColumn("_s", F.explode(steps)).withColumn("tx", F.col("cx") + F.col("_s.dx"))
            .withColumn("ty", F.col("cy") + F.col("_s.dy")).drop("_s"))


def _boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min(F.struct("x", "y")).alias("rep"))


def _linked_cells(core: DataFrame, cells: DataFrame, eps: float, side: float, max_levels: int = 30) -> DataFrame:
    """Pairs of neighbouring cells that hold core points within eps of each other.

    Two cells may hold very many points each, so point pairs are never listed. Bounding
    boxes settle a pair if they are surely near or surely far; only the undecided ones
    are cut into 4 x 4 smaller boxes, again and again. A box with one distinct point is
    always settled, which ends the rounds.
    """
    a = _neighbour_cells(cells.select("cx", "cy"), half=True)
    pairs = a.join(cells.select(F.col("cx").alias("tx"), F.col("cy").alias("ty")), ["tx", "ty"]).select(
        F.struct("cx", "cy").alias("a"), F.struct(F.col("tx").alias("cx"), F.col("ty").alias("cy")).alias("b"))
    open_pairs = pairs.select("a", "b", F.lit(0).cast("bigint").alias("ax"), F.lit(0).cast("bigint").alias("ay"),
                              F.lit(0).cast("bigint").alias("bx"), F.lit(0).cast("bigint").alias("by"))
    located = core.withColumn("cell", F.struct("cx", "cy"))
    linked = None
    for level in range(max_levels):
        width = side / 4 ** level
        sub = located.select(
            "cell", "x", "y", F.floor((F.col("x") - F.col("cx") * side) / width).cast("bigint").alias("sx"),
            F.floor((F.col("y") - F.col("cy") * side) / width).cast("bigint").alias("sy"))
        if level:
            wanted = open_pairs.select(F.col("a").alias("cell"), F.col("ax").alias("sx"), F.col("ay").alias("sy")).unionByName(
                open_pairs.select(F.col("b").alias("cell"), F.col("bx").alias("sx"), F.col("by").alias("sy"))).distinct()
            sub = sub.join(wanted, ["cell", "sx", "sy"], "left_semi")
        else:
            sub = sub.withColumn("sx", F.lit(0).cast("bigint")).withColumn("sy", F.lit(0).cast("bigint"))
        boxes = _boxes(sub, ["cell", "sx", "sy"])
        left = boxes.select(F.col("cell").alias("a"), F.col("sx").alias("ax"), F.col("sy").alias("ay"), *[
            F.col(c).alias(f"a_{c}") for c in ("x0", "x1", "y0", "y1", "rep")])
        right = boxes.select(F.col("cell").alias("b"), F.col("sx").alias("bx"), F.col("sy").alias("by"), *[
            F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "y1", "rep")])
        both = open_pairs.join(left, ["a", "ax", "ay"]).join(right, ["b", "bx", "by"])

        def gap(d: str) -> Column:
            return F.greatest(F.col(f"a_{d}0") - F.col(f"b_{d}1"), F.col(f"b_{d}0") - F.col(f"a_{d}1"), F.lit(0.0))

        def reach(d: str) -> Column:
            return F.greatest(F.col(f"a_{d}1") - F.col(f"b_{d}0"), F.col(f"b_{d}1") - F.col(f"a_{d}0"))

        def reps() -> Column:
            return F.pow(F.col("a_rep.x") - F.col("b_rep.x"), 2) + F.pow(F.col("a_rep.y") - F.col("b_rep.y"), 2)

        near = (F.pow(reach("x"), 2) + F.pow(reach("y"), 2) <= eps * eps) | (reps() <= eps * eps)
        far = F.pow(gap("x"), 2) + F.pow(gap("y"), 2) > eps * eps
        judged = cut(both.select("a", "ax", "ay", "b", "bx", "by", near.alias("near"), far.alias("far")))
        yes = judged.where("near").select("a", "b").distinct()
        linked = yes if linked is None else linked.unionByName(yes)
        undecided = judged.where("NOT near AND NOT far").join(yes, ["a", "b"], "left_anti")
        if undecided.isEmpty():
            return linked
        steps = F.sequence(F.lit(0), F.lit(3))
        for c in ("ax", "ay", "bx", "by"):
            undecided = undecided.withColumn("_s", F.explode(steps)).withColumn(c, F.col(c) * 4 + F.col("_s")).drop("_s")
        open_pairs = undecided.select("a", "b", "ax", "ay", "bx", "by")
    raise RuntimeError("cell boxes did not settle")


def dbscan(points: DataFrame, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """(key, x, y) -> (key, x, y, cluster, kind): exact density clusters in two dimensions.

    Cells have the diagonal eps: a cell with min_points is all core points without
    looking at distances, and the other cells hold fewer points than that, so the
    neighbour joins stay linear. A cluster is named after its smallest core key; border
    points go to the smallest such name, noise has cluster -1.
    """
    side = eps / math.sqrt(2)
    # pairs in one cell are near even where the division rounds
    p = cut(points.select("key", "x", "y", F.floor(F.col("x") / side).cast("bigint").alias("cx"),
                          F.floor(F.col("y") / side).cast("bigint").alias("cy")))
    counts = p.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    dense = counts.where(F.col("n") >= min_points)
    thin = p.join(counts.where(F.col("n") < min_points), ["cx", "cy"])
    target = p.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("x").alias("bx"), F.col("y").alias("by"))
    probes = _neighbour_cells(thin.select("key", "n", "cx", "cy", F.col("x").alias("ax"), F.col("y").alias("ay")))
    found = probes.join(target, ["tx", "ty"]).where(_near(eps, "a", "b")).groupBy("key").agg(F.count("*").alias("m"))
    judged = cut(thin.join(found, "key", "left").withColumn(
        "core", F.col("n") + F.coalesce("m", F.lit(0)) >= min_points).select("key", "x", "y", "cx", "cy", "core"))
    core = cut(p.join(dense.select("cx", "cy"), ["cx", "cy"], "left_semi").select("key", "x", "y", "cx", "cy")
               .unionByName(judged.where("core").drop("core")))
    cells = core.select("cx", "cy").distinct()
    links = _linked_cells(core, cells, eps, side)
    comp = connected_components(cells.select(F.struct("cx", "cy").alias("v")), links)
    by_cell = comp.select(F.col("v.cx").alias("cx"), F.col("v.cy").alias("cy"), "component")
    names = core.join(by_cell, ["cx", "cy"]).groupBy("component").agg(F.min("key").alias("cluster"))
    cell_cluster = cut(by_cell.join(names, "component").select("cx", "cy", "cluster"))
    core_out = core.join(cell_cluster, ["cx", "cy"]).select("key", "x", "y", "cluster", F.lit("core").alias("kind"))
    rest = judged.where("NOT core")
    around = _neighbour_cells(rest.select("key", "cx", "cy", F.col("x").alias("ax"), F.col("y").alias("ay")))
    own = rest.select("key", "cx", "cy", F.col("x").alias("ax"), F.col("y").alias("ay"),
                      F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    core_target = core.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("x").alias("bx"), F.col("y").alias("by"))
    touching = (around.unionByName(own).join(core_target, ["tx", "ty"]).where(_near(eps, "a", "b"))
                .select("key", F.col("tx").alias("cx"), F.col("ty").alias("cy")).distinct()
                .join(cell_cluster, ["cx", "cy"]).groupBy("key").agg(F.min("cluster").alias("cluster")))
    rest_out = rest.join(touching, "key", "left").select(
        "key", "x", "y", F.coalesce("cluster", F.lit(-1)).alias("cluster"),
        F.when(F.col("cluster").isNull(), "noise").otherwise("border").alias("kind"))
    return core_out.unionByName(rest_out)


# ---- centroids -------------------------------------------------------------

def _vector_sum(col: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(col)))


def cosine_centroids(df: DataFrame, cluster: str, key: str, column: str = "embedding") -> DataFrame:
    """(key, cluster, weight, similarity) to the density-weighted centroid of the cluster.

    The weight of a row, its mean product with the other rows, is (x . S - x . x) / n with
    S the sum of the cluster: two aggregations instead of all pairs.
    """
    x = df.select(key, cluster, F.col(column).cast("array<double>").alias("x"))
    sums = x.groupBy(cluster).agg(F.count("*").alias("n"), _vector_sum(F.col("x")).alias("s"))
    weighed = join_few(x, sums, cluster).withColumn("weight", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(
        (V.dot(F.col("x"), F.col("s")) - V.dot(F.col("x"), F.col("x"))) / F.col("n")))
    scaled = F.transform("x", lambda v: v * F.col("weight"))
    centre = weighed.groupBy(cluster).agg(F.sum("weight").alias("w"), _vector_sum(scaled).alias("c"),
                                          F.first("s").alias("s0"), F.first("n").alias("n0"))
    centre = centre.select(cluster, F.when(F.col("w") == 0, F.transform("s0", lambda v: v / F.col("n0"))).otherwise(
        F.transform("c", lambda v: v / F.col("w"))).alias("centroid"))
    similarity = F.least(F.greatest(V.dot(F.col("x"), F.col("centroid")), F.lit(-1.0)), F.lit(1.0))
    return join_few(weighed, centre, cluster).select(key, cluster, "weight", similarity.alias("similarity"))


def inverse_distances(a: np.ndarray, b: np.ndarray, same: bool, strip: int = STRIP_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the inverse distances of the places a to all of b, and of b to all of a; ``same`` leaves out a place with itself."""
    left, right = np.zeros(len(a)), np.zeros(len(b))
    for at in range(0, len(a), strip):
        x = a[at:at + strip]
        for first in range(0, len(b), COLUMNS):
            y = b[first:first + COLUMNS]
            inv = x[:, None, 0] - y[None, :, 0]
            np.hypot(inv, x[:, None, 1] - y[None, :, 1], out=inv)
            inv += 1e-8
            np.divide(1.0, inv, out=inv)
            if same and at < first + len(y) and first < at + len(x):
                i = np.arange(max(at, first), min(at + len(x), first + len(y)))
                inv[i - at, i - first] = 0.0
            left[at:at + strip] += inv.sum(1)
            right[first:first + COLUMNS] += inv.sum(0)
    return left, right


def centroids_2d(points: DataFrame, cluster: str, key: str) -> DataFrame:
    """(key, cluster, x, y) -> weight, distance and similarity to the inverse-distance centroid.

    The weight sums the inverse distance to every other row of the cluster. A cluster is
    cut into blocks and every pair of blocks is one task of bounded size, worked through in
    pieces of a few MB, that returns one partial weight per row; no task holds a cluster and no row is
    left out. Quadratic, as the definition is: a row is copied once per block of its cluster.
    ``cosine_centroids`` is the linear way to a density-weighted centroid.
    """
    sizes = points.groupBy(cluster).agg(F.count("*").alias("n"), F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("blocks"))
    p = points.select(key, cluster, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    mine = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    tiles = (join_few(p, sizes, cluster).withColumn("block", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    strip = STRIP_ROWS
    kinds = dict(points.dtypes)

    def weights(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        left, right = inverse_distances(a[["x", "y"]].to_numpy(), b[["x", "y"]].to_numpy(), i == j, strip)
        if i == j:
            return pd.DataFrame({key: a[key].to_numpy(), "w": left})
        return pd.DataFrame({key: np.concatenate([a[key], b[key]]), "w": np.concatenate([left, right])})

    partial = grouped(tiles.select(key, cluster, "x", "y", "block", "i", "j"), cluster, "i", "j").applyInPandas(
        weights, f"{key} {kinds[key]}, w double")
    # read three times below: keep it, or the tiles would run three times
    weighed = cut(p.join(partial.groupBy(key).agg(F.sum("w").alias("weight")), key))
    total = F.sum("weight")
    centre = weighed.groupBy(cluster).agg(
        F.when(total == 0, F.avg("x")).otherwise(F.sum(F.col("weight") * F.col("x")) / total).alias("mx"),
        F.when(total == 0, F.avg("y")).otherwise(F.sum(F.col("weight") * F.col("y")) / total).alias("my"))
    away = join_few(weighed, centre, cluster).withColumn(
        "distance", F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)))
    spread = away.groupBy(cluster).agg(F.stddev_pop("distance").alias("sd"))
    return join_few(away, spread, cluster).withColumn("similarity", F.exp(
        -F.col("distance") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)))).select(
        key, cluster, "weight", "distance", "similarity")


def cluster_stats(similar: DataFrame, cluster: str) -> DataFrame:
    return similar.groupBy(cluster).agg(
        F.count("*").alias("size"), F.avg("similarity").alias("avg_similarity"),
        F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"))


def top_members(similar: DataFrame, cluster: str, key: str, n: int = 5) -> DataFrame:
    """The n most similar members per cluster; Spark cuts each group to n rows before the shuffle."""
    w = Window.partitionBy(cluster).orderBy(F.desc("similarity"), key)
    return similar.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
