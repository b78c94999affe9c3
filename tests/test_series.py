"""Stationarity, decomposition and signals against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import series


def frame(spark, named):
    rows = [(k, i, float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, t long, x double").repartition(4)


RNG = np.random.default_rng(3)
NOISE, WALK = RNG.normal(0, 1, 500), np.cumsum(RNG.normal(0, 1, 500))
WAVE = np.sin(np.arange(240) * 2 * math.pi / 12) * 3 + np.arange(240) * 0.1 + RNG.normal(0, 0.2, 240)
SERIES = {"noise": NOISE, "walk": WALK, "wave": WAVE, "short": RNG.normal(0, 1, 30)}


def fit(z, y):
    beta, *_ = np.linalg.lstsq(z, y, rcond=None)
    ssr = float(((y - z @ beta) ** 2).sum())
    return beta, ssr


def brute_adf(x):
    n = len(x)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(x)

    def design(lags, start):
        t = np.arange(start, n)
        return np.column_stack([x[t - 1], *[d[t - 1 - i] for i in range(1, lags + 1)], np.ones(len(t))]), d[t - 1]

    best, best_aic = 0, math.inf
    for lags in range(top + 1):
        z, y = design(lags, top + 1)
        _, ssr = fit(z, y)
        aic = len(y) * math.log(ssr / len(y)) + 2 * z.shape[1]
        if aic < best_aic - 1e-9:
            best, best_aic = lags, aic
    z, y = design(best, best + 1)
    beta, ssr = fit(z, y)
    cov = np.linalg.inv(z.T @ z) * ssr / (len(y) - z.shape[1])
    return beta[0] / math.sqrt(cov[0, 0]), best


def brute_kpss(x):
    n, e = len(x), x - x.mean()
    eta = (np.cumsum(e) ** 2).sum() / n ** 2
    s0, s1 = (e @ e) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        prod = (e[i:] @ e[:-i]) / (n / 2)
        s0, s1 = s0 + prod, s1 + i * prod
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = e @ e + 2 * sum((e[i:] @ e[:-i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return eta / (long_run / n), lags


@pytest.mark.parametrize("block", [4096, 64])
def test_adf(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK", block)
    got = {r["k"]: r for r in series.adf(frame(spark, SERIES), "k", ["t"], "x").collect()}
    for k, x in SERIES.items():
        stat, lags = brute_adf(x)
        assert got[k]["lags"] == lags
        assert got[k]["statistic"] == pytest.approx(stat, rel=1e-6)
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]


def test_adf_ignores_constant_series(spark):
    assert series.adf(frame(spark, {"c": [1.0] * 50}), "k", ["t"], "x").count() == 0


def test_unit_root_p_at_known_critical_values():
    # large-sample critical values with a constant: 1 %, 5 %, 10 %
    for tau, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert series.unit_root_p(tau) == pytest.approx(p, abs=0.002)


@pytest.mark.parametrize("block", [4096, 64])
def test_kpss(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK", block)
    got = {r["k"]: r for r in series.kpss(frame(spark, SERIES), "k", ["t"], "x").collect()}
    for k, x in SERIES.items():
        stat, lags = brute_kpss(x)
        assert (got[k]["lags"], got[k]["statistic"]) == (lags, pytest.approx(stat, rel=1e-9))
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]


@pytest.mark.parametrize("block", [4096, 24])
def test_decompose(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK", block)
    named = {"wave": WAVE, "short": WAVE[:20]}
    d = series.decompose(frame(spark, named), "k", ["t"], "x")
    got = d.toPandas().sort_values("t").reset_index(drop=True)
    assert set(got["k"]) == {"wave"} and len(got) == 240
    w = np.array([0.5, *[1] * 11, 0.5]) / 12
    trend = np.convolve(WAVE, w, "valid")
    np.testing.assert_allclose(got["trend"].to_numpy()[6:-6], trend)
    assert got["trend"].isna().sum() == 12
    np.testing.assert_allclose(got.groupby(got["t"] % 12)["seasonal"].first().mean(), 0, atol=1e-9)
    s = series.strengths(d, "k").first()
    assert s["trend_strength"] > 0.5 and s["seasonal_strength"] > 0.05 and s["residual_strength"] < 0.05


def test_signals(spark):
    t = np.arange(4096)
    named = {"slow": np.sin(2 * np.pi * 8 * t / 256), "fast": np.sin(2 * np.pi * 32 * t / 256 + 0.1)}
    framed = series.frames(frame(spark, named), "k", ["t"], "x", 256)
    e = {r["k"]: r for r in series.energy(framed, "k").collect()}
    z = {r["k"]: r["zcr_mean"] for r in series.zero_crossings(framed, "k").collect()}
    s = {r["k"]: r for r in series.spectrum(framed, "k", 256, 256.0).collect()}
    assert e["slow"]["rms_mean"] == pytest.approx(math.sqrt(0.5), rel=1e-6) and e["slow"]["rms_std"] < 1e-9
    assert z["fast"] == pytest.approx(64 / 256, abs=0.01) and z["slow"] == pytest.approx(16 / 256, abs=0.01)
    assert s["slow"]["spectral_centroid_mean"] == pytest.approx(8, abs=0.1)
    assert s["fast"]["spectral_rolloff_mean"] == pytest.approx(33, abs=1.1)


def test_identical_signals_have_no_drift(spark):
    f = series.signal_features(frame(spark, {"a": NOISE, "b": WAVE}), "k", ["t"], "x", 64)
    from plumbline.plans.frames import two_sides
    got = {r["attr"]: r["score"] for r in series.audio_drift(two_sides(f, f)).collect()}
    assert set(got) == {*series.AUDIO_FEATURES, "overall"} and max(got.values()) < 1e-9


def test_order_parses_text(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-02 00:00:00"), ("a", 2, "2024-01-01 00:00:00")], "k string, id int, ts string")
    got = {r["id"]: r["pos"] for r in series.ts_order(df, "k", "ts", "id").collect()}
    assert got == {1: 1, 2: 0}


def test_pandas_is_only_a_helper():
    assert pd.DataFrame(series._design(np.arange(6.0) ** 2, 2, 5, 1)).shape == (3, 4)
