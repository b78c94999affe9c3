"""Single linkage against joining the nearest clusters one after another."""

import numpy as np
import pytest

from plumbline.operators import linkage


def brute(p, k):
    """Clusters by their smallest index: links in order of length and ends, until k are left; equal places are never parted."""
    n = len(p)
    d2 = (p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2
    a, b = np.triu_indices(n, 1)
    label, left = np.arange(n), n
    for e in np.lexsort((b, a, d2[a, b])):
        i, j = label[a[e]], label[b[e]]
        if i != j:
            if left <= k and d2[a[e], b[e]] > 0:
                break
            label[label == max(i, j)] = min(i, j)
            left -= 1
    return label.tolist()


def frame(spark, p):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "key long, x double, y double")


def got(spark, p, k):
    found = {r["key"]: r["cluster"] for r in linkage.single_linkage(frame(spark, p), k).collect()}
    return [found[i] for i in range(len(p))]


def shapes(name):
    draw = np.random.default_rng(11)
    if name == "clusters":  # five groups, a hot place, scattered rows
        parts = [draw.normal(c, 0.2, (90, 2)) for c in ((0, 0), (3, 0.5), (0, 4), (6, 6), (-5, 2))]
        return np.concatenate([*parts, np.repeat([[1.5, 1.5]], 30, axis=0), draw.uniform(-8, 8, (20, 2))])
    if name == "lines":  # two long parallel lines and one bridge
        x = np.arange(120) * 0.1
        return np.concatenate([np.column_stack([x, 0 * x]), np.column_stack([x, 0 * x + 1.3]), [[5.0, 0.7]]])
    return np.stack(np.meshgrid(np.arange(12.0), np.arange(9.0)), -1).reshape(-1, 2)  # all links alike


@pytest.mark.parametrize("name,k", [("clusters", 5), ("lines", 2), ("grid", 7)])
def test_single_linkage(spark, name, k):
    p = shapes(name)
    p = p[np.random.default_rng(2).permutation(len(p))]
    assert got(spark, p, k) == brute(p, k)


def test_odd_rows(spark):
    p = [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 0.0)]
    assert got(spark, p, 3) == [0, 0, 2, 2]
    assert got(spark, p, 1) == [0, 0, 0, 0]
    assert got(spark, p, None) == [0, 0, 2, 2]
    assert linkage.single_linkage(frame(spark, p).where("key < 0"), 2).count() == 0
    odd = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, float("inf"), 0.0), (4, 0.0, 0.0), (5, 1.0, 0.0), (6, 9.0, 0.0)],
                                "key long, x double, y double")
    assert {r["key"]: r["cluster"] for r in linkage.single_linkage(odd, 2).collect()} == {1: None, 2: None, 3: None, 4: 4, 5: 4, 6: 6}


def test_spanning_forest(spark):
    draw = np.random.default_rng(7)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in draw.integers(0, 60, (150, 2)) if a != b})
    rows = [(a, b, (float(draw.integers(0, 5)), a, b)) for a, b in edges]
    label, want = list(range(60)), set()
    for link, a, b in sorted((link, a, b) for a, b, link in rows):
        if label[a] != label[b]:
            want.add((a, b))
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
    links = spark.createDataFrame(rows, "a long, b long, link struct<d2: double, p: long, q: long>")
    assert {(r["a"], r["b"]) for r in linkage.spanning_forest(links).collect()} == want


@pytest.mark.parametrize("name,k", [("clusters", 5), ("lines", 2)])
def test_number_of_jobs(spark, name, k):
    """Each SQL execution leaves a plan and compiled code in the driver, whose memory grew with their number."""
    seen = spark._jsparkSession.sharedState().statusStore()
    before = max([0, *(e.executionId() for e in _executions(seen))])
    p = shapes(name)
    assert got(spark, p, k) == brute(p, k)
    assert max(e.executionId() for e in _executions(seen)) - before <= 80


def _executions(seen):
    found = seen.executionsList()
    return [found.apply(i) for i in range(max(0, found.size() - 1), found.size())]


@pytest.mark.parametrize("few", [0, 40])
def test_beyond_one_task(spark, monkeypatch, few):
    """The rounds that replace the one task give the same clusters."""
    monkeypatch.setattr(linkage, "ONE_TASK", few)
    p = shapes("clusters")[::7]
    assert got(spark, p, 5) == brute(p, 5)


def test_text_keys(spark):
    p = [(0.0, 0.0), (0.1, 0.0), (5.0, 0.0), (5.1, 0.0), (9.0, 9.0), (9.0, 9.1)]
    df = spark.createDataFrame([(f"k{i}", x, y) for i, (x, y) in enumerate(p)], "key string, x double, y double")
    assert {r["key"]: r["cluster"] for r in linkage.single_linkage(df, 3).collect()} == {f"k{i}": f"k{i - i % 2}" for i in range(6)}
