"""Drift scores: identical pairs, shifted pairs, brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalar import finite_map, general_text, quality_score, status_label
from plumbline.functions.text import ATTRIBUTES, with_text_attributes
from plumbline.operators import drift, embedding as E, fusion, profile, series
from plumbline.plans.frames import to_long, two_sides


def sides(spark, base, target, name="x"):
    b = spark.createDataFrame(pd.DataFrame({name: np.asarray(base, float)}))
    t = spark.createDataFrame(pd.DataFrame({name: np.asarray(target, float)}))
    return to_long(two_sides(b, t), [name])


def score(df):
    return df.first()["score"]


RNG = np.random.default_rng(42)
X, Y = RNG.normal(0, 1, 400), RNG.normal(1.5, 1, 300)


def brute_w1(x, y):
    values = np.sort(np.concatenate([x, y]))
    f = np.searchsorted(np.sort(x), values[:-1], side="right") / len(x)
    g = np.searchsorted(np.sort(y), values[:-1], side="right") / len(y)
    return float(np.sum(np.abs(f - g) * np.diff(values)))


def brute_psi(x, y, bins=10):
    edges = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), bins + 1)
    b, t = np.histogram(x, edges)[0], np.histogram(y, edges)[0]
    p, q = (b + 1) / (b.sum() + bins), (t + 1) / (t.sum() + bins)
    return abs(float(np.sum((q - p) * np.log(q / p))))


@pytest.mark.parametrize("fn", [drift.psi, drift.kl, drift.wasserstein, drift.kolmogorov_smirnov])
def test_identical_is_zero(spark, fn):
    assert abs(score(fn(sides(spark, X, X)))) < 1e-6


@pytest.mark.parametrize("fn", [drift.psi, drift.kl, drift.wasserstein, drift.kolmogorov_smirnov])
def test_shifted_is_positive(spark, fn):
    assert score(fn(sides(spark, X, Y))) > 0.05


def test_psi_matches_histogram(spark):
    assert score(drift.psi(sides(spark, X, Y))) == pytest.approx(brute_psi(X, Y), abs=1e-9)


def test_psi_constant_is_zero_for_unequal_counts(spark):
    assert score(drift.psi(sides(spark, [3.0] * 5, [3.0] * 50))) == 0


def test_wasserstein_is_exact_and_symmetric(spark):
    a, b = score(drift.wasserstein(sides(spark, X, Y))), score(drift.wasserstein(sides(spark, Y, X)))
    assert a == pytest.approx(brute_w1(X, Y), abs=1e-9) and a == pytest.approx(b, abs=1e-9)


def test_kl_baseline_edges_drop_outside(spark):
    long = sides(spark, [0, 1, 2, 3] * 10, [0, 1, 2, 3] * 10 + [99.0] * 40)
    assert score(drift.kl(long, edges="baseline")) == 0
    assert score(drift.kl(long)) > 0.1


def test_mean_delta_by_hand(spark):
    long = sides(spark, [30, 40], [40, 50, 60])
    row = drift.mean_delta(long).first()
    assert (row["base_mean"], row["target_mean"], row["delta"]) == (35.0, 50.0, 15.0)


def test_missing_rate_by_hand(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, ""), (3, 7, "b"), (None, 8, None), (5, 9, "c")], "id int, value int, score string")
    got = {r["column"]: r["missing_rate"] for r in profile.missing_rate(df).collect()}
    assert got == {"id": 0.2, "value": 0.2, "score": 0.4}


def test_timeseries_pair(spark):
    def table(mu, seed):
        rng = np.random.default_rng(seed)
        return spark.createDataFrame(pd.DataFrame({"x": rng.normal(mu, 1, 200), "y": rng.normal(0, 1, 200)}))
    def run(a, b):
        long = to_long(two_sides(a, b), ["x", "y"])
        return drift.moments_drift(long.withColumnRenamed("attr", "series"), "series").first()["score"]
    assert run(table(0, 42), table(1.5, 43)) > 0.05
    assert run(table(0, 42), table(0, 42)) < 1e-6


def test_text_pair(spark):
    words = [("alpha",), ("beta",)] * 10
    sentences = [("The quick brown fox jumps over the lazy dog near the river bank.",)] * 20
    def run(a, b):
        df = two_sides(spark.createDataFrame(a, "text string"), spark.createDataFrame(b, "text string"))
        return fusion.text_overall(with_text_attributes(df, "text", "en")).first()["overall_score"]
    assert run(words, sentences) > 0.5
    assert run(words, words) < 1e-6


def test_text_attributes_by_hand(spark):
    df = spark.createDataFrame([("The cat. The DOG!",), (None,), ("",)], "text string")
    rows = with_text_attributes(df, "text", "en").collect()
    a = rows[0]
    assert (a["length_chars"], a["length_words"]) == (17, 6)
    assert a["stopword_ratio"] == pytest.approx(2 / 6) and a["vocab_diversity"] == pytest.approx(5 / 6)
    assert a["special_char_ratio"] == pytest.approx(2 / 17) and a["whitespace_ratio"] == pytest.approx(3 / 17)
    assert a["readability"] == pytest.approx(100 - 1.5 * 3)
    assert all(rows[i][c] == 0 for i in (1, 2) for c in ATTRIBUTES)


def test_audio_pair(spark):
    def tone(side, hz):
        return spark.range(8000).select(F.lit(side).alias("signal_id"), F.col("id").alias("pos"),
                                        (0.3 * F.sin(2 * math.pi * hz * F.col("id") / 8000)).alias("value"))
    def centroid(df):
        framed = series.frames(df, "signal_id", ["pos"], "value", 2048)
        return series.spectrum(framed, "signal_id", 2048, 8000.0).first()
    low, high = centroid(tone("a", 440)), centroid(tone("b", 880))
    assert abs(low["spectral_centroid_mean"] - high["spectral_centroid_mean"]) > 100
    assert low["spectral_rolloff_mean"] == pytest.approx(440, abs=10)


def test_image_pair(spark):
    def table(brightness):
        return spark.createDataFrame([(f"i{i}", float(brightness + i), 0.1 * i, 1.0) for i in range(5)],
                                     "item_key string, brightness double, noise_level double, size double")
    def run(a, b):
        return {r["attr"]: r["score"] for r in drift.image_attribute_drift(two_sides(a, b)).collect()}
    same, moved = run(table(10), table(10)), run(table(10), table(200))
    assert max(same.values()) < 1e-6
    assert moved["overall"] > 0.05 and moved["exposure"] == 0 and len(moved) == 11


def test_jensen_shannon_bounds(spark):
    a, b = spark.createDataFrame([("x",)] * 4, "c string"), spark.createDataFrame([("y",)] * 4, "c string")
    assert score(drift.jensen_shannon(two_sides(a, b), ["c"])) == pytest.approx(1.0)
    assert score(drift.jensen_shannon(two_sides(a, a), ["c"])) == 0


# ---- embeddings ------------------------------------------------------------

def emb(spark, x, y):
    rows = [("base", i, list(map(float, v))) for i, v in enumerate(x)] + [("target", 10_000 + i, list(map(float, v))) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "side string, key long, embedding array<double>")


def brute_mmd(x, y, gamma):
    def k(a, b):
        return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1))
    up = lambda m: m[np.triu_indices(len(m), 1)].mean()
    return math.sqrt(max(up(k(x, x)) + up(k(y, y)) - 2 * k(x, y).mean(), 0))


EX, EY = RNG.normal(0, 1, (60, 6)), RNG.normal(0.7, 1, (45, 6))


@pytest.mark.parametrize("tile", [2048, 16])
def test_mmd_is_exact_for_any_tile(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE_ROWS", tile)
    got = {r["gamma"]: r["mmd"] for r in E.mmd(emb(spark, EX, EY), [0.1, 1.0]).collect()}
    for g, v in got.items():
        assert v == pytest.approx(brute_mmd(EX, EY, g), abs=1e-9)


def test_mmd_per_set_cannot_see_a_shift(spark):
    d = emb(spark, EX, EX + 5)
    assert E.mmd(d, [0.1], standardize="per_set").first()["mmd"] == pytest.approx(0, abs=1e-3)
    assert E.mmd(d, [0.1]).first()["mmd"] > 0.3


def test_mmd_strips_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(E, "STRIP_ROWS", 7)
    assert E.mmd(emb(spark, EX, EY), [0.1]).first()["mmd"] == pytest.approx(brute_mmd(EX, EY, 0.1), abs=1e-9)


def test_mmd_copies_a_row_once_per_block(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE_ROWS", 35)
    copies = E.tiles(emb(spark, EX, EY)).groupBy("side", "embedding").count().select("count").distinct().collect()
    assert [r[0] for r in copies] == [3]
    assert E.STRIP_ROWS * 8 == 16_384


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_features_lie_within_their_error(spark, seed):
    for x, y, g in ((EX, EY, 0.1), (EX, EX + 0.01, 0.5), (EX, EY, 1.0)):
        got = E.mmd_rff(emb(spark, x, y), [g], seed=seed).first()
        def k(a, b):
            return np.exp(-g * ((a[:, None] - b[None]) ** 2).sum(-1))
        up = lambda m: m[np.triu_indices(len(m), 1)].mean()
        square = up(k(x, x)) + up(k(y, y)) - 2 * k(x, y).mean()
        assert abs(got["square"] - square) <= 4 * got["square_error"]
        assert got["mmd"] == pytest.approx(math.sqrt(max(got["square"], 0)))


@pytest.mark.parametrize("rows", [30, 20_500])
def test_the_method_does_not_depend_on_the_size(spark, rows):
    d = spark.range(rows).select(F.when(F.col("id") % 2 == 0, "base").otherwise("target").alias("side"), F.col("id").alias("key"),
                                 F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("embedding"))
    assert E.mmd_multiscale(d, [0.5]).first()["mmd_method"] == "exact"
    assert E.mmd_multiscale(d, [0.5], method="random_features").first()["mmd_method"] == "random_features"
    with pytest.raises(ValueError):
        E.mmd_multiscale(d, [0.5], method="auto")


def test_identical_embeddings(spark):
    d = emb(spark, EX, EX)
    m = E.mean_distances(d).first()
    assert abs(m["mean_shift"]) < 1e-9 and abs(m["cosine"]) < 1e-9
    assert E.wasserstein_projected(d).first()[0] < 1e-9
    assert E.psi_pca_row(d).first()["psi_max"] < 1e-9


def test_psi_pca_matches_numpy(spark):
    got = sorted(r["score"] for r in E.psi_pca(emb(spark, EX, EY), score_components=3).collect())
    _, _, vt = np.linalg.svd(EX - EX.mean(0), full_matrices=False)
    want = sorted(brute_psi(EX @ vt[i], EY @ vt[i]) for i in range(3))
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_pairwise_cosine_is_the_mean_over_pairs(spark):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    got = E.pairwise_cosine(emb(spark, EX, EY)).first()["score"]
    assert got == pytest.approx(1 - (unit(EX) @ unit(EY).T).mean(), abs=1e-9)
    assert E.pairwise_cosine(emb(spark, EX, EY).where("side = 'base'")).first()["score"] == 1.0


def test_ensembles(spark):
    same, moved = emb(spark, EX, EX), emb(spark, EX, EY)
    # the unbiased kernel distance of a set to itself is not quite zero
    assert E.ensemble_text(same).first()["ensemble"] < E.ensemble_text(moved).first()["ensemble"]
    v = E.ensemble_vision(moved).first()
    want = (0.30 * min(v["mmd_mean"] / 0.5, 1) + 0.25 * min(v["mean_shift"] / 0.1, 1) + 0.20 * min(v["wasserstein"], 1)
            + 0.15 * min(v["psi_mean"] / 0.25, 1) + 0.10 * min(v["cosine"], 1))
    assert v["ensemble"] == pytest.approx(want)


def test_service_ensemble_uses_what_is_there(spark):
    row = spark.createDataFrame([(0.25, 0.05)], "size_kl double, mean_shift double")
    got = E.ensemble_service(row).first()["ensemble"]
    assert got == pytest.approx((0.1 * 0.5 + 0.2 * 0.5) / 0.3)


def test_advanced_needs_five_rows(spark):
    attrs = to_long(two_sides(*[spark.range(20).select(*[(F.col("id") * k).alias(n) for k, n in enumerate(("size", "noise", "sharpness"), s)])
                                for s in (1, 2)]), ["size", "noise", "sharpness"])
    assert fusion.advanced(attrs, emb(spark, EX[:4], EY)).first()["has_embeddings"] is False
    few, enough = fusion.advanced(attrs, emb(spark, EX[:4], EY)), fusion.advanced(attrs, emb(spark, EX[:5], EY))
    assert enough.first()["has_embeddings"] is True and enough.first()["mmd_method"] == "exact"
    assert set(few.columns) == set(enough.columns) and few.first()["mmd_method"] is None
    short = fusion.advanced(attrs.where("value < 4 OR side = 'target'"), emb(spark, EX, EY)).first()
    assert short["has_attributes"] is False and short["size_kl"] is None and short["ensemble"] > 0


# ---- fusion and detectors --------------------------------------------------

def results(spark):
    return spark.createDataFrame([("r1", "image", 0.4, "success"), ("r1", "text", 0.2, "success"), ("r1", "audio", 9.0, "error"),
                                  ("r2", "text", 0.3, "success"), ("r3", "image", 1.4, "success"), ("r3", "text", -0.5, "success")],
                                 "run string, modality string, overall_score double, status string")


@pytest.mark.parametrize("strategy,weights,want", [
    ("weighted", None, {"r1": 0.3, "r2": None, "r3": 0.45}),
    ("weighted", {"image": 3.0, "text": 1.0, "video": 5.0}, {"r1": 0.35, "r2": None, "r3": 0.925}),
    ("weighted", {"video": 1.0}, {"r1": 0.3, "r2": None, "r3": 0.45}),
    ("max", None, {"r1": 0.4, "r2": None, "r3": 1.4}),
    ("joint", None, {"r1": 1 - 0.6 * 0.8, "r2": None, "r3": 1.0}),
    ("none", None, {"r1": None, "r2": None, "r3": None})])
def test_fusion(spark, strategy, weights, want):
    got = {r["run"]: r["fused_score"] for r in fusion.fuse(results(spark), strategy, weights).collect()}
    for run, value in want.items():
        assert got[run] == (None if value is None else pytest.approx(value))


def test_fusion_errors_and_weights(spark):
    assert fusion.parse_weights("image=0.6, text=0.4,") == {"image": 0.6, "text": 0.4}
    with pytest.raises(ValueError):
        fusion.parse_weights("image")
    with pytest.raises(ValueError):
        fusion.fuse(results(spark), "median")
    ignored = {r["run"]: r["ignored_weights"] for r in fusion.fuse(results(spark), "weighted", {"image": 1.0, "video": 1.0}).collect()}
    assert ignored["r1"] == "video" and ignored["r2"] == "image,video"


def test_detector_names(spark):
    assert fusion.resolve_detector("text", "mmd") == "ensemble"
    for modality, name in (("text", "wasserstein"), ("audio", "mmd"), ("nope", "default")):
        with pytest.raises(fusion.UnsupportedDetector):
            fusion.resolve_detector(modality, name)


# ---- scalars ---------------------------------------------------------------

def test_scalars(spark):
    row = spark.range(1).select(
        status_label(F.lit(0.15)).alias("a"), status_label(F.lit(0.149)).alias("b"), status_label(F.lit(0.25)).alias("c"),
        quality_score(F.lit(50.0), F.lit(0.25)).alias("q"),
        finite_map(F.create_map(F.lit("x"), F.lit(float("nan")), F.lit("y"), F.lit(1.0))).alias("m")).first()
    assert tuple(row)[:4] == ("WARNING", "NORMAL", "CRITICAL", 50.0) and row["m"] == {"x": None, "y": 1.0}


@pytest.mark.parametrize("x", [0.7, 0.0, 1.0, 123456.7, 1234567.0, 0.00001234567, -0.5, 99999.96, 3e-05, 1e16, 0.1 + 0.2])
def test_general_text_is_percent_g(spark, x):
    assert spark.range(1).select(general_text(F.lit(x)).alias("t")).first()["t"] == f"{x:.6g}"


def test_not_a_number_is_no_value(spark):
    dirty = [1.0, 2.0, 3.0, float("nan"), float("inf"), float("-inf")]
    assert sides(spark, dirty, [1.0, 2.0, 3.0]).count() == 6
    assert abs(score(drift.psi(sides(spark, dirty, [1.0, 2.0, 3.0])))) < 1e-9


def test_skewed_values_and_sides(spark):
    """A third of the rows share one value; the sides differ in size."""
    x = np.concatenate([np.full(200, 5.0), RNG.exponential(3, 400)])
    y = np.concatenate([np.full(10, 5.0), RNG.exponential(4, 90)])
    long = sides(spark, x, y)
    assert score(drift.wasserstein(long)) == pytest.approx(brute_w1(x, y), abs=1e-9)
    assert score(drift.wasserstein_relative(long)) == pytest.approx(brute_w1(x, y) / max(abs(x.mean()), 1), abs=1e-9)
    assert score(drift.psi(long)) == pytest.approx(brute_psi(x, y), abs=1e-9)


def test_summary_is_one_reading(spark):
    x = np.concatenate([np.full(300, -2.0), RNG.normal(1e6, 3, 500)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.ones(len(x))}))
    got = {r["column"]: r for r in profile.describe_numeric(df, ["x", "y"]).collect()}
    d = pd.Series(x).describe()
    for a, b in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert got["x"][a] == pytest.approx(d[b], rel=1e-9)
    assert got["y"]["std"] == 0


def test_distribution_profile(spark):
    x = np.concatenate([np.zeros(50), RNG.exponential(2, 300)])
    rows = [("a", float(v)) for v in x] + [("b", 0.0)] * 4 + [("c", 1.0), ("c", 2.0)]
    got = {r["k"]: r for r in profile.distribution_profile(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    pos, a = x[x > 0], got["a"]
    for p in profile.PERCENTILES:
        assert a[f"p{p}"] == pytest.approx(np.percentile(pos, p))
    assert a["skewness"] == pytest.approx((((pos - pos.mean()) / pos.std()) ** 3).mean())
    assert a["n_high"] == (x > np.percentile(x, 90)).sum() and a["q50"] == pytest.approx(np.median(x))
    assert (a["shape"], got["b"]["shape"], got["c"]["shape"]) == ("right_skewed", "no_activation", "insufficient_data")


def test_kernel_sums_need_few_mb():
    """Four workers share an executor's memory; matrices of a strip by a block took each of them more than a GB."""
    import tracemalloc
    draw = np.random.default_rng(5)
    a, b = draw.normal(0, 0.2, (3000, 4)), draw.normal(0.1, 0.2, (8192, 4))
    gammas = [2.0, 0.3, 0.1, 0.5, 1.0, 5.0]
    tracemalloc.start()
    found, n = E.kernel_sums(a, b, gammas, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and n == 3000 * 8192
    few = b[:700]
    d2 = ((few[:, None] - few[None]) ** 2).sum(-1)[np.triu_indices(len(few), 1)]
    for clip in (None, 0.05):
        got, n = E.kernel_sums(few, few, gammas, True, clip, strip=90)
        assert n == len(d2)
        assert got == pytest.approx([np.exp(-g * (d2 if clip is None else np.clip(d2, -clip, clip))).sum() for g in sorted(gammas)], rel=1e-12)


def test_detectors_share_one_pass_over_the_pairs(spark):
    d = emb(spark, EX, EY)
    known = E.kernels_of_ensembles(d)
    calls = []
    for modality, name in (("image", "mmd"), ("text", "mmd_only"), ("image", "ensemble"), ("text", "default")):
        one = fusion.embedding_drift(d, modality, name).first()["embedding_drift"]
        shared = fusion.embedding_drift(d, modality, name, known=known)
        assert shared.first()["embedding_drift"] == pytest.approx(one, abs=1e-12)
        calls.append("FlatMapGroupsInPandas" in shared._jdf.queryExecution().toString())
    assert not any(calls)


def test_kernel_sums_stay_in_the_same_few_matrices():
    import tracemalloc
    draw = np.random.default_rng(6)
    a, b = draw.normal(0, 0.2, (3000, 4)), draw.normal(0.1, 0.2, (4096, 4))
    for gammas, most in ((E.VISION_GAMMAS, 2.5e6), ([1.0], 2.0e6)):
        tracemalloc.start()
        E.kernel_sums(a, b, gammas, False)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most
    d2 = ((a[:500, None] - b[None, :300]) ** 2).sum(-1)
    for gammas in ([0.5, 0.5, 1.0], [0.3, 0.7], [0.3, 0.7, 1.4, 2.1], [0.0, 1.0], [0.01, 1.0]):
        found, n = E.kernel_sums(a[:500], b[:300], gammas, False, strip=90)
        assert n == d2.size and found == pytest.approx([np.exp(-g * d2).sum() for g in gammas], rel=1e-11)


def test_small_tables_are_dealt_over_many_pairs_of_blocks(spark):
    rows = spark.range(24_000).select(F.when(F.col("id") % 2 == 0, "base").otherwise("target").alias("side"), F.col("id").alias("key"),
                                      F.array((F.col("id") % 7).cast("float")).alias("embedding"))
    t = E.tiles(rows)
    assert t.select("i", "j").distinct().count() == 24 * 25 // 2 and t.count() == 24 * 24_000
    assert E.tiles(rows.where("key < 900")).select("i", "j").distinct().count() == 1


@pytest.mark.parametrize("standardize", ["none", "per_set"])
@pytest.mark.parametrize("key", [None, 7])
def test_rows_that_share_a_key_are_dealt_over_blocks(spark, monkeypatch, key, standardize):
    monkeypatch.setattr(E, "TILE_ROWS", 16)
    rows, sizes, tiles = emb(spark, EX, EY).withColumn("key", F.lit(key).cast("long")), [], E.tiles

    def seen(d):
        t = tiles(d)
        sizes.extend(r["count"] for r in t.where("i = j").groupBy("i").count().collect())
        return t

    monkeypatch.setattr(E, "tiles", seen)
    got = E.mmd(rows, [0.1], standardize=standardize).first()["mmd"]
    x, y = (EX, EY) if standardize == "none" else [(m - m.mean(0)) / (m.std(0) + 1e-8) for m in (EX, EY)]
    assert got == pytest.approx(brute_mmd(x, y, 0.1), abs=1e-9)
    # 105 rows in 7 blocks of 15 on average
    assert sum(sizes) == 105 and max(sizes) < 40


def test_vectors_of_a_block_come_without_an_object_a_row(spark):
    import pyarrow as pa
    known = E.kernels_of_ensembles(emb(spark, EX, EY))
    plans = [d._jdf.queryExecution().toString() for d in (E.mmd(emb(spark, EX, EY), [0.5]), E.mmd_multiscale(emb(spark, EX, EY), [0.5], known=known))]
    assert ["FlatMapGroupsInArrow" in p for p in plans] == [True, False] and "FlatMapGroupsInPandas" not in plans[0]
    parts = pa.chunked_array([pa.array([[0.5, 1.0], [2.0, None]], pa.list_(pa.float32())), pa.array([[3.0, 4.0]], pa.list_(pa.float32()))])
    found = E.matrix(parts[1:])
    assert found.dtype == np.float64 and np.array_equal(found, [[2, np.nan], [3, 4]], equal_nan=True)
    assert E.matrix(parts[:0]) is None
    for odd in ([[1.0], [1.0, 2.0]], [[1.0], None], [None]):
        with pytest.raises(ValueError):
            E.matrix(pa.chunked_array([pa.array(odd, pa.list_(pa.float64()))]))
    nothing = emb(spark, EX, EY).where("side = 'base'")
    assert [r["mmd"] for r in E.mmd(nothing, [0.5]).collect()] == [0.0] and E.mmd(nothing.where("key < 0"), [0.5]).collect() == []


def test_kernel_sums_go_over_a_piece_few_times(monkeypatch):
    """Seconds of the exact kernel distance: a product of rows that lie together, one cut at 0 and one exponential for a single width."""
    draw = np.random.default_rng(7)
    a, b = draw.normal(0, 0.2, (600, 4)), draw.normal(0.1, 0.2, (700, 4))
    passes, together = {}, []
    for name in ("matmul", "maximum", "minimum", "multiply", "exp", "clip"):
        def spy(x, *rest, real=getattr(np, name), name=name, **options):
            out = real(x, *rest, **options)
            passes[name] = passes.get(name, 0) + out.size
            if name == "matmul":
                together.append(x.flags.c_contiguous and rest[0].flags.c_contiguous)
            return out
        monkeypatch.setattr(E.np, name, spy)
    found, n = E.kernel_sums(a, b, [1.0], False)
    monkeypatch.undo()
    assert passes == {"matmul": n, "minimum": n, "exp": n} and all(together)
    assert found == pytest.approx([np.exp(-((a[:, None] - b[None]) ** 2).sum(-1)).sum()], rel=1e-12)


def test_kernel_sums_of_copies_and_odd_widths():
    draw = np.random.default_rng(8)
    a = np.repeat(draw.normal(50, 20, (1, 5)), 300, axis=0)
    # rounding leaves no kernel above 1
    found, n = E.kernel_sums(a, a, [0.5, 3.0], True)
    assert n == 300 * 299 // 2 and all(n * (1 - 1e-9) < k <= n for k in found)
    few, more = draw.normal(0, 0.3, (40, 3)), draw.normal(0, 0.3, (50, 3))
    d2 = ((few[:, None] - more[None]) ** 2).sum(-1)
    for gammas in ([0.0], [0.0, 0.0], [-1.0, 0.0], [-1.0, 0.7], [0.01, 1.0, 1.0]):
        for clip in (None, 0.1):
            found, n = E.kernel_sums(few, more, gammas, False, clip)
            assert found == pytest.approx([np.exp(-g * (d2 if clip is None else np.clip(d2, -clip, clip))).sum() for g in gammas], rel=1e-11)
