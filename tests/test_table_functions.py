"""Table functions against the operator over DataFrames."""

import random
import sys
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from plumbline.functions import tables
from plumbline.operators import drift
from plumbline.plans.frames import to_long, two_sides

SCHEMA = "part string, side string, x double, y int, z decimal(9,2), key string, value string, lo int"


@pytest.fixture(scope="module")
def view(spark):
    tables.register(spark)
    draw = random.Random(1)
    rows = []
    for i in range(4000):
        part = "hot" if i % 10 else draw.choice(["a", "b", None])
        x = draw.choice([draw.gauss(0, 1), 3.0, float("nan"), float("inf"), None])
        rows.append((part, draw.choice(["base", "target", "other", None]), x, 7, Decimal(i % 13), "k", "v", 1))
    rows += [("lonely", "base", 1.0, 1, Decimal(1), "k", "v", 1), ("constant", "base", 2.0, 1, Decimal(1), "k", "v", 1)] + [("constant", "target", 2.0, 1, Decimal(1), "k", "v", 1)] * 9
    spark.createDataFrame(rows, SCHEMA).createOrReplaceTempView("mixed")
    return "mixed"


@pytest.mark.parametrize("parts", [1, 5, None])
def test_scores_of_groups(spark, view, parts):
    got = {(r.part, r.attr): (r.n_base, r.n_target, round(r.score, 9)) for r in tables.psi(spark, view, "side", ["x", "y", "z"], ["part"], parts=parts).collect()}
    df = spark.table(view)
    want = {}
    for part in ("hot", "a", "b", None, "lonely", "constant"):
        here = df.where(df["part"].eqNullSafe(part))
        long = to_long(two_sides(here.where("side = 'base'"), here.where("side = 'target'")), ["x", "y", "z"]).cache()
        counts = {(r.attr, r.side): r["count"] for r in long.groupBy("attr", "side").count().collect()}
        for r in drift.psi(long).collect():
            want[part, r.attr] = (counts.get((r.attr, "base"), 0), counts.get((r.attr, "target"), 0), round(r.score, 9))
    assert got == want
    assert got["constant", "x"] == (1, 9, 0.0) and got["lonely", "z"][2] == 0.0 and got["hot", "x"][2] > 0


def test_whole_table_and_empty_table(spark, view):
    assert {r.attr for r in tables.psi(spark, view, "side", ["x", "z"]).collect()} == {"x", "z"}
    spark.table(view).where("false").createOrReplaceTempView("nothing")
    assert tables.psi(spark, "nothing", "side", ["x"], ["part"]).collect() == []


def test_any_table_of_counts(spark):
    tables.register(spark)
    spark.sql("""SELECT * FROM VALUES (DATE '2024-01-01', 'base', 0, 3L, 'u'), (DATE '2024-01-01', 'base', 1, 1L, 'u'), (DATE '2024-01-01', 'target', 1, 4L, 'u'),
                 (DATE '2024-01-02', 'base', 0, 3L, 'v') t(day, side, bin, n, name)""").createOrReplaceTempView("counts")
    out = spark.sql("SELECT * FROM psi_of_bins(TABLE(SELECT * FROM counts) PARTITION BY (day, name), 2) ORDER BY day")
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        ("day", "date"), ("name", "string"), ("n_base", "bigint"), ("n_target", "bigint"), ("score", "double")]
    p, q = np.array([4, 2]) / 6, np.array([1, 5]) / 6
    first, second = out.collect()
    assert first.score == pytest.approx(abs(np.sum((q - p) * np.log(q / p)))) and (second.n_target, second.score) == (0, 0.0)


def test_what_the_analysis_refuses(spark):
    tables.register(spark)
    for call, words in (("psi_of_bins(TABLE(SELECT 1 AS side, 2 AS bin), 10)", "misses the columns"), ("psi_of_bins(TABLE(SELECT 1 AS side, 2 AS bin, 3 AS n), 0)", "constant number"),
                        ("psi_of_bins(1, 10)", "takes a table")):
        with pytest.raises(Exception, match=words):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_state_does_not_grow_with_rows():
    state = tables.PsiBins()
    for i in range(200):
        n = 5000
        batch = pa.record_batch({"key": ["k"] * n, "side": ["base", "target"] * (n // 2), "value": np.random.default_rng(i).random(n), "lo": [0.0] * n, "hi": [1.0] * n})
        assert list(state.eval(batch, pa.array([10]))) == []
    assert len(state.counts) == 2 and sum(sys.getsizeof(a) for a in state.counts.values()) < 1000
    assert sum(next(state.terminate()).column("n").to_pylist()) == 1_000_000


def test_rows_are_counted_where_they_lie(spark, view):
    """Only counts are shuffled: no exchange and no sort by salted keys under the function that takes the rows."""
    plan = tables.psi(spark, view, "side", ["x", "y"], ["part"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "part#" in plan
    assert "hashpartitioning(_pythonudtf" not in plan.split("psi_bins", 1)[1] and "pmod(monotonically" not in plan


def test_state_does_not_grow_with_keys(monkeypatch):
    monkeypatch.setattr(tables, "MOST", 50)
    state, seen = tables.PsiBins(), 0
    for i in range(40):
        batch = pa.record_batch({"key": [f"k{i}-{j}" for j in range(20)], "side": ["base"] * 20, "value": [0.5] * 20, "lo": [0.0] * 20, "hi": [1.0] * 20})
        seen += sum(sum(t.column("n").to_pylist()) for t in state.eval(batch, pa.array([10])))
        assert len(state.counts) <= 50
    assert seen + sum(next(state.terminate()).column("n").to_pylist()) == 800
