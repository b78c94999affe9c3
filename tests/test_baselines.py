"""Sketches against the exact forms, within the error that is returned with them."""

import random

import pytest

from plumbline.operators import baselines, drift
from plumbline.plans.frames import to_long, two_sides


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    out = []
    for i in range(20_000):
        side = "base" if i % 3 else "target"
        out.append((side, i % 5, draw.gauss(0 if side == "base" else 0.4, 1), float(draw.randint(0, 3)), 7.0, draw.choice([None, float("nan"), 1.0]),
                    draw.random() if side == "base" else None))
    return spark.createDataFrame(out, "side string, day int, x double, few double, same double, odd double, lonely double")


COLUMNS = ["x", "few", "same", "odd", "lonely"]


def split(rows, side, keys=()):
    return to_long(rows.where(f"side = '{side}'"), COLUMNS, ids=("side", *keys))


def test_distances_within_their_error(spark, rows):
    got = {r.attr: r for r in baselines.compare(baselines.baseline(split(rows, "base")), baselines.baseline(split(rows, "target"))).collect()}
    long = to_long(rows, COLUMNS).cache()
    ks, w1 = ({r.attr: r.score for r in f(long).collect()} for f in (drift.kolmogorov_smirnov, drift.wasserstein))
    for attr in ("x", "few", "same", "odd"):
        r = got[attr]
        assert r.ks == pytest.approx(ks[attr], abs=r.ks_error) and r.wasserstein == pytest.approx(w1[attr], abs=r.wasserstein_error + 1e-12)
        assert 0 < r.ks_error < 0.03
    assert got["same"].wasserstein == 0 and got["same"].ks == 0 and got["x"].ks > 0.1
    assert (got["lonely"].n_target, got["lonely"].ks, got["lonely"].wasserstein) == (0, None, None)
    assert got["x"].n_base + got["x"].n_target == 20_000


def test_days_merge_into_the_whole(spark, rows, tmp_path):
    days = baselines.baseline(split(rows, "base", ("day",)), ["day"])
    days.write.parquet(str(tmp_path / "days"))
    kept = spark.read.parquet(str(tmp_path / "days"))
    whole, together = baselines.baseline(split(rows, "base")), baselines.merged(kept)
    cols = ["attr", "n", "lo", "hi"]
    assert sorted(whole.select(cols).collect()) == sorted(together.select(cols).collect())
    for r in baselines.compare(together, whole).collect():
        assert r.ks <= r.ks_error
    # a merged day is that day
    assert baselines.compare(baselines.merged(kept.where("day = 2")), kept.where("day = 2").drop("day")).agg({"ks": "max"}).first()[0] == 0


def test_small_groups_keys_and_empty_tables(spark):
    long = spark.createDataFrame([("u", "a", 1.0), ("u", "a", 2.0), ("v", "a", 5.0)], "part string, attr string, value double")
    base = baselines.baseline(long, ["part"])
    other = baselines.baseline(long.withColumn("value", long.value + 1), ["part"])
    got = {r.part: (round(r.ks, 6), round(r.wasserstein, 6)) for r in baselines.compare(base, other, ["part"]).collect()}
    assert got == {"u": (0.5, 1.0), "v": (1.0, 1.0)}
    assert baselines.baseline(long.where("false")).collect() == []
    assert baselines.compare(base.where("false").drop("part"), base.where("false").drop("part")).collect() == []


def test_a_sketch_does_not_grow_with_the_rows(spark):
    def size(n):
        long = spark.range(n).selectExpr("'a' AS attr", "CAST(id AS double) AS value")
        return baselines.baseline(long).selectExpr("octet_length(sketch)").first()[0]
    assert size(1_000_000) < 1.5 * size(20_000) < 20_000
