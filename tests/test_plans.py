"""Ordered scans, percentiles, blocks and components against plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.plans.cdf import quantiles
from plumbline.plans.components import connected_components
from plumbline.plans import frames, ordered
from plumbline.plans.frames import exact_sample, with_scalars
from plumbline.plans.ordered import halo_blocks, numbered, scan


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows under one key; many ties of the value."""
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"key": key, "id": np.arange(n), "v": rng.integers(0, 50, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_scan_matches_groupwise_sums(hot):
    pdf, df = hot
    got = scan(df, ["key"], ["v", "id"], running={"c": "v"}, lead={"nxt": "v"}, lag={"prv": "v"}, chunks=7).toPandas()
    got = got.sort_values(["key", "v", "id"]).reset_index(drop=True)
    want = pdf.sort_values(["key", "v", "id"]).reset_index(drop=True)
    g = want.groupby("key")["v"]
    np.testing.assert_allclose(got["c"], g.cumsum())
    np.testing.assert_allclose(got["c_total"], g.transform("sum"))
    pd.testing.assert_series_equal(got["nxt"], g.shift(-1), check_names=False)
    pd.testing.assert_series_equal(got["prv"], g.shift(1), check_names=False)


@pytest.mark.parametrize("keys", [["key"], []])
def test_plain_windows_and_chunks_give_the_same(hot, keys):
    _, df = hot
    def rows(**way):
        out = scan(df, keys, ["v", "id"], running={"c": "v", "n": F.lit(1)}, lead={"nxt": "v"}, lag={"prv": "id"}, **way)
        return out.columns, sorted(map(tuple, out.collect()), key=lambda r: r[1])
    assert rows() == rows(plain_bytes=0) == rows(chunks=5)


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 5.0)], "k string, id int, v double")
    got = {(r["k"], r["id"]): (r["c"], r["c_total"]) for r in scan(df, ["k"], ["id"], running={"c": "v"}).collect()}
    assert got == {(None, 1): (1.0, 3.0), (None, 2): (3.0, 3.0), ("a", 1): (5.0, 5.0)}


def test_hot_key_is_spread_over_chunks(hot):
    from plumbline.plans.ordered import range_chunks
    _, df = hot
    chunks = range_chunks(df, ["key"], ["v", "id"], 8).where("key = 0").groupBy("_chunk").count().toPandas()
    assert len(chunks) >= 3


def test_numbered_over_whole_table(hot):
    pdf, df = hot
    got = numbered(df, [], ["v", "id"], "pos", chunks=6).toPandas().sort_values(["v", "id"])
    assert got["pos"].tolist() == list(range(len(pdf)))
    assert set(got["pos_total"]) == {len(pdf)}


def test_quantiles_are_exact(hot):
    pdf, df = hot
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, ["key"], "v", probs).toPandas()
    for key, group in pdf.groupby("key"):
        q = got[got["key"] == key].sort_values("p")["q"].to_numpy()
        np.testing.assert_allclose(q, np.quantile(group["v"], probs))


def test_quantiles_single_value_and_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (2, 1.0), (2, 2.0)], "k int, v double")
    got = {(r["k"], r["p"]): r["q"] for r in quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {(1, 0.5): 5.0, (2, 0.5): 1.5}


def test_halo_blocks_hold_their_neighbours(spark):
    df = spark.range(20).withColumnRenamed("id", "pos")
    got = halo_blocks(df, "pos", 5, 2, 1).toPandas()
    assert got["own"].sum() == 20
    for block, group in got.groupby("block"):
        own = group.loc[group["own"], "pos"]
        if len(own) == 0:
            continue
        want = [p for p in range(20) if own.min() - 2 <= p <= own.max() + 1]
        assert sorted(group["pos"]) == want


def test_components_of_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101)], "a long, b long")
    vertices = spark.createDataFrame([(i,) for i in [*range(n + 1), 100, 101, 200]], "v long")
    got = {r["v"]: r["component"] for r in connected_components(vertices, edges).collect()}
    assert {got[i] for i in range(n + 1)} == {0}
    assert got[100] == got[101] == 100 and got[200] == 200


def test_exact_sample_is_repeatable(hot):
    _, df = hot
    a = sorted(r["id"] for r in exact_sample(df, 25, "id", 7).collect())
    b = sorted(r["id"] for r in exact_sample(df.repartition(3), 25, "id", 7).collect())
    assert a == b and len(a) == 25


def test_with_scalars(spark):
    df = with_scalars(spark.range(3), spark.range(5).agg(F.count("*").alias("n")))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(0, 5), (1, 5), (2, 5)]


# ---- one key with nine tenths of the rows ----------------------------------

def test_chunks_of_a_hot_key_are_even(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(F.lit(1)).cast("bigint").alias("k"), "id")
    chunked = ordered.range_chunks(df, ["k"], ["id"], chunks=20)
    sizes = [r["n"] for r in chunked.groupBy("_chunk").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("few", [0, 100])
def test_join_with_one_row_per_key(spark, monkeypatch, few):
    monkeypatch.setattr(frames, "FEW_KEYS", few)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, 7).otherwise(F.col("id") % 5).alias("k"))
    got = frames.join_few(rows, rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert {(r["k"], r["n"]) for r in got.collect()} == {(7, 900), *((i, 20) for i in range(5))} and got.count() == 1000
    assert ("Hint" in got._jdf.queryExecution().logical().toString()) == bool(few)
