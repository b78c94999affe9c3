"""Clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cluster


def brute_dbscan(p, eps, m):
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= m
    label = np.full(len(p), -1)
    for i in range(len(p)):
        if not core[i] or label[i] >= 0:
            continue
        stack, label[i] = [i], i
        while stack:
            for k in np.flatnonzero(near[stack.pop()] & core):
                if label[k] < 0:
                    label[k] = i
                    stack.append(k)
    for i in np.flatnonzero(~core):
        hits = label[near[i] & core]
        if len(hits):
            label[i] = hits.min()
    return label, core


def points(seed):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(c, 0.25, (40, 2)) for c in ((0, 0), (1.2, 0.2), (4, 4))]
    rows += [np.repeat([[7.0, 7.0]], 60, axis=0), rng.uniform(-2, 9, (60, 2))]  # a hot spot, and noise
    rows += [np.column_stack([np.arange(30) * 0.29, np.full(30, -3.0)])]  # a chain
    return np.concatenate(rows)


@pytest.mark.parametrize("seed,eps,m", [(0, 0.3, 5), (1, 0.29, 3), (2, 0.5, 5)])
def test_dbscan(spark, seed, eps, m):
    p = points(seed)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "key long, x double, y double")
    got = {r["key"]: r for r in cluster.dbscan(df, eps, m).collect()}
    label, core = brute_dbscan(p, eps, m)
    assert [got[i]["cluster"] for i in range(len(p))] == label.tolist()
    assert [got[i]["kind"] == "core" for i in range(len(p))] == core.tolist()


def test_two_dense_cells_with_undecided_boxes(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 0.7, (200, 2))
    for gap, joined in ((0.95, True), (1.02, False)):
        b = rng.uniform(0, 0.7, (200, 2)) + [0.7 + gap, 0]
        # one pair of points fixes the smallest distance
        p = np.concatenate([a, b, [[0.7, 0.35]], [[0.7 + gap, 0.35]]])
        df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "key long, x double, y double")
        got = cluster.dbscan(df, 1.0, 5).select("cluster").distinct().count()
        assert (got == 1) == joined
        assert got == len(set(brute_dbscan(p, 1.0, 5)[0]))


@pytest.mark.parametrize("tile", [2048, 8])
def test_centroids_2d(spark, monkeypatch, tile):
    monkeypatch.setattr(cluster, "TILE_ROWS", tile)
    rng = np.random.default_rng(9)
    p = rng.normal(0, 1, (50, 2))
    df = spark.createDataFrame([(i, 1, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(99, 2, 5.0, 5.0)],
                               "key long, label int, x double, y double")
    got = {r["key"]: r for r in cluster.centroids_2d(df, "label", "key").collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    w = (1 / (d + 1e-8)).sum(1)
    c = (w[:, None] * p).sum(0) / w.sum()
    away = np.sqrt(((p - c) ** 2).sum(1))
    for i in range(50):
        assert got[i]["weight"] == pytest.approx(w[i])
        assert got[i]["similarity"] == pytest.approx(np.exp(-away[i] / away.std()))
    assert got[99]["distance"] == 0 and got[99]["similarity"] == 1


def test_cosine_centroid_identity(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (40, 5))
    df = spark.createDataFrame([(i, 0, list(map(float, v))) for i, v in enumerate(x)] + [(77, 1, [1.0, 0.0, 0.0, 0.0, 0.0])],
                               "key long, label int, embedding array<double>")
    got = {r["key"]: r for r in cluster.cosine_centroids(df, "label", "key").collect()}
    g = x @ x.T
    np.fill_diagonal(g, 0)
    w = g.mean(1)
    c = np.average(x, axis=0, weights=w)
    for i in range(40):
        assert got[i]["weight"] == pytest.approx(w[i])
        assert got[i]["similarity"] == pytest.approx(float(np.clip(x[i] @ c, -1, 1)))
    assert got[77]["similarity"] == pytest.approx(1.0)


def blobs(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "key long, c1 double, c2 double")


@pytest.mark.parametrize("select", ["silhouette", "elbow"])
def test_kmeans_finds_three(spark, select):
    got = cluster.kmeans(blobs(spark), select=select).toPandas()
    assert got["cluster"].nunique() == 3
    assert (got.groupby(got["key"] // 40)["cluster"].nunique() == 1).all()


def test_hierarchical_and_rules(spark):
    assert cluster.hierarchical(blobs(spark)).select("cluster").distinct().count() == 5
    assert cluster.kmeans(blobs(spark), select="manual").select("cluster").distinct().count() == 6
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (4, 9, 19, 49, 99, 100, 1000)], "n long").select(
        cluster.rule_k(F.col("n"))).collect()]
    assert got == [1, 2, 3, 4, 5, 5, 8]
    assert [cluster.fallback_k(n) for n in (5, 15, 22, 90)] == [1, 2, 4, 4]


def test_coordinates_match_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (80, 6)) * [5, 3, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "key long, embedding array<double>")
    coords, axes, ratio = cluster.principal_coordinates(df, 2)
    got = coords.toPandas().sort_values("key")[["c1", "c2"]].to_numpy()
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (x - x.mean(0)) @ vt[:2].T
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)
    np.testing.assert_allclose(ratio, (s ** 2 / (s ** 2).sum())[:2], atol=1e-9)
    for axis in axes:
        assert axis[int(np.argmax(np.abs(axis)))] > 0


def test_top_members(spark):
    df = spark.createDataFrame([(i, 0, float(i % 7)) for i in range(30)], "key long, label int, similarity double")
    got = cluster.top_members(df, "label", "key").collect()
    assert [(r["rank"], r["similarity"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 6.0), (2, 6.0), (3, 6.0), (4, 6.0), (5, 5.0)]


def test_chain_of_projected_clusters(spark):
    """Coordinates to top five, against numpy on the same clusters."""
    from plumbline.queries.clusters import cluster_chain, coords2
    sf = "/root/testdata/sf0.001"
    got = cluster_chain(spark, sf).collect()
    coords = {r["key"]: (r["c1"], r["c2"]) for r in coords2(spark, sf).collect()}
    found = {r["key"]: r["cluster"] for r in cluster.kmeans(coords2(spark, sf), k=10).collect()}
    for c in set(found.values()):
        keys = sorted(k for k, v in found.items() if v == c)
        p = np.array([coords[k] for k in keys])
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) + 1e-8
        np.fill_diagonal(d, np.inf)
        w = (1 / d).sum(1)
        centre = (w[:, None] * p).sum(0) / w.sum() if w.sum() > 0 else p.mean(0)
        away = np.sqrt(((p - centre) ** 2).sum(1))
        similar = np.exp(-away / (away.std() if away.std() > 0 else 1.0))
        rows = sorted((r for r in got if r["cluster"] == c), key=lambda r: r["rank"])
        assert len(rows) == min(5, len(keys)) and rows[0]["size"] == len(keys)
        np.testing.assert_allclose([r["similarity"] for r in rows], np.sort(similar)[::-1][:5], atol=1e-6)
        assert rows[0]["avg_similarity"] == pytest.approx(similar.mean(), abs=1e-6)


def test_projected_density_clusters(spark):
    from plumbline.queries.clusters import cluster_dbscan_projected, coords2
    sf = "/root/testdata/sf0.001"
    rows = sorted(coords2(spark, sf).collect(), key=lambda r: r["key"])
    want = brute_dbscan(np.array([(r["c1"], r["c2"]) for r in rows]), 0.02, 5)[0]
    got = {r["key"]: r["cluster"] for r in cluster_dbscan_projected(spark, sf).collect()}
    assert len({c for c in got.values() if c != -1}) == len({c for c in want if c != -1})


def test_inverse_distances_need_few_mb():
    """Four workers share an executor's memory; matrices of a strip by a block took each of them more than a GB."""
    import tracemalloc
    p = np.random.default_rng(4).normal(0, 1, (5000, 2))
    tracemalloc.start()
    left, right = cluster.inverse_distances(p, p, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    inv = 1 / (np.hypot(*(p[:, None] - p[None, :300]).transpose(2, 0, 1)) + 1e-8)
    inv[np.arange(300), np.arange(300)] = 0
    assert np.allclose(right[:300], inv.sum(0), rtol=1e-9) and np.allclose(left, right, rtol=1e-9)
    some, rest = cluster.inverse_distances(p[:700], p[700:1000], False, strip=64)
    wide = 1 / (np.hypot(*(p[:700, None] - p[None, 700:1000]).transpose(2, 0, 1)) + 1e-8)
    assert np.allclose(some, wide.sum(1)) and np.allclose(rest, wide.sum(0))
