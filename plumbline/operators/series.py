"""Time series and signals.

A series is the rows of one key in time order. No operator puts a whole series in
one task: positions and running sums come from range chunks, and everything that
looks at neighbours works on blocks of a fixed number of rows with their edge rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.frames import grouped, join_few, to_long
from ..plans.ordered import halo_blocks, numbered, scan
from ..plans.scratch import cut, pieces, written
from .drift import wasserstein

BLOCK = 4096
PERIOD = 12


def ts_order(df: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """Rows with their position in the series; text timestamps are parsed."""
    if dict(df.dtypes)[ts] == "string":
        df = df.withColumn(ts, F.try_to_timestamp(F.col(ts)))
    return numbered(df, [key], [ts, row_id], "pos")


def decompose(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Additive trend, seasonal and resid with period 12; series under 24 rows are left out.

    The trend is the centred 2x12 moving average, null at six rows on both ends; the
    seasonal part is the mean of x - trend per phase, centred to mean 0.
    """
    rows = numbered(df.select(key, *order, F.col(value).cast("double").alias("x")).where("x IS NOT NULL"),
                    [key], order, "pos").withColumnRenamed("pos_total", "n").where(F.col("n") >= 2 * PERIOD)
    half = PERIOD // 2
    blocks = halo_blocks(rows, "pos", BLOCK, half, half, total="n")
    w = Window.partitionBy(key, "block").orderBy("pos")
    around = F.sum("x").over(w.rowsBetween(-half, half))
    ends = F.lag("x", half).over(w) + F.lead("x", half).over(w)
    inside = (F.col("pos") >= half) & (F.col("pos") < F.col("n") - half)
    trended = written(blocks.withColumn("trend", F.when(inside, (around - 0.5 * ends) / PERIOD))
                      .where("own").drop("block", "own").withColumn("phase", F.pmod("pos", F.lit(PERIOD))), "trended")
    phase = trended.groupBy(key, "phase").agg(F.avg(F.col("x") - F.col("trend")).alias("m"))
    seasonal = phase.withColumn("seasonal", F.col("m") - F.avg("m").over(Window.partitionBy(key))).drop("m")
    return (join_few(trended, seasonal, [key, "phase"])
            .withColumn("resid", F.col("x") - F.col("trend") - F.col("seasonal")).drop("phase"))


def strengths(decomposed: DataFrame, key: str) -> DataFrame:
    """Variance of each component over the variance of the series."""
    total = F.var_pop("x") + 1e-10
    return decomposed.groupBy(key).agg(
        (F.var_pop("trend") / total).alias("trend_strength"), (F.var_pop("seasonal") / total).alias("seasonal_strength"),
        (F.var_pop("resid") / total).alias("residual_strength"))


# ---- stationarity ----------------------------------------------------------

def _autocovariance(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, e, lags) -> (key, lag, s) with s = sum of e[t] * e[t + lag], lag 1..lags."""
    size = F.greatest(F.col("lags"), F.lit(BLOCK))
    blocks = halo_blocks(rows, "pos", size, 0, F.col("lags")).select(key, "block", "own", "pos", "e", "lags")

    def partial_sums(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        e, m, lags = pdf["e"].to_numpy(), int(pdf["own"].sum()), int(pdf["lags"].iloc[0])
        lags = min(lags, len(e) - 1)
        sums = [float(np.dot(e[:m][:len(e) - i], e[i:i + m])) for i in range(1, lags + 1)]
        return pd.DataFrame({key: group[0], "lag": np.arange(1, lags + 1), "s": sums})

    kind = dict(rows.dtypes)[key]
    return (grouped(blocks, key, "block").applyInPandas(partial_sums, f"{key} {kind}, lag bigint, s double")
            .groupBy(key, "lag").agg(F.sum("s").alias("s")))


# KPSS level statistic and its p value (Kwiatkowski et al. 1992).
KPSS_TABLE = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]


def kpss(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """KPSS level test; the lag rule is that of Hobijn, Franses and Ooms (1998)."""
    x = df.select(key, *order, F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    s = scan(x, [key], order, running={"rank": F.lit(1).cast("bigint"), "c": "x"})
    mean = F.col("c_total") / F.col("rank_total")
    rows = s.select(key, (F.col("rank") - 1).alias("pos"), F.col("rank_total").alias("n"),
                    (F.col("x") - mean).alias("e"), (F.col("c") - F.col("rank") * mean).alias("partial"))
    stats = rows.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.pow("partial", 2)).alias("eta"),
                                  F.sum(F.pow("e", 2)).alias("ss"))
    first_lags = F.floor(F.pow(F.col("n"), 2 / 9))
    first = _autocovariance(rows.select(key, "pos", "e", first_lags.alias("lags")), key)
    prod = F.col("s") / (F.col("n") / 2)
    sums = (stats.join(first, key, "left").groupBy(key)
            .agg(F.max("n").alias("n"), F.max("eta").alias("eta"), F.max("ss").alias("ss"),
                 (F.max(F.col("ss") / F.col("n")) + F.coalesce(F.sum(prod), F.lit(0.0))).alias("s0"),
                 F.coalesce(F.sum(F.col("lag") * prod), F.lit(0.0)).alias("s1")))
    gamma = 1.1447 * F.pow(F.pow(F.col("s1") / F.col("s0"), 2), 1 / 3)
    # one row per series, read twice below
    chosen = cut(sums.withColumn("lags", F.least(F.floor(gamma * F.pow("n", 1 / 3)), F.col("n") - 1)).drop("s0", "s1"))
    second = _autocovariance(join_few(rows.select(key, "pos", "e"), chosen.select(key, "lags"), key).where("lags > 0"), key)
    weighted = F.col("s") * (1 - F.col("lag") / (F.col("lags") + 1))
    out = (chosen.join(second, key, "left").groupBy(key)
           .agg(F.max("n").alias("n"), F.max("lags").alias("lags"), F.max("eta").alias("eta"),
                (F.max("ss") + 2 * F.coalesce(F.sum(weighted), F.lit(0.0))).alias("long_run")))
    stat = (F.col("eta") / F.pow("n", 2)) / (F.col("long_run") / F.col("n"))
    p = F.when(F.col("statistic") <= KPSS_TABLE[0][0], KPSS_TABLE[0][1])
    for (s0, p0), (s1, p1) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        p = p.when(F.col("statistic") <= s1, p0 + (F.col("statistic") - s0) * (p1 - p0) / (s1 - s0))
    p = p.when(F.col("statistic").isNotNull(), KPSS_TABLE[-1][1])
    return (out.select(key, "n", "lags", stat.alias("statistic")).withColumn("p_value", p)
            .withColumn("stationary", F.col("p_value") > 0.05))


# Response surface of the unit root p value with a constant (MacKinnon 1994).
TAU_MIN, TAU_STAR, TAU_MAX = -18.83, -1.61, 2.74
TAU_SMALL = [2.1659, 1.4412, 0.038269]
TAU_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]


def unit_root_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coefficients = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    z = sum(c * tau ** i for i, c in enumerate(coefficients))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _design(y: np.ndarray, start: int, stop: int, lags: int) -> np.ndarray:
    """Rows [1, y[t-1], d[t-1] .. d[t-lags], d[t]] for t in start..stop-1, d the differences of y."""
    d = np.diff(y)
    t = np.arange(start, stop)
    cols = [np.ones(len(t)), y[t - 1]] + [d[t - 1 - i] for i in range(1, lags + 1)] + [d[t - 1]]
    return np.column_stack(cols)


def _fit(gram: np.ndarray, lags: int, total: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Least squares on the first 2 + lags columns out of the cross products."""
    use = list(range(2 + lags))
    xx, xy, yy = gram[np.ix_(use, use)], gram[use, total], gram[total, total]
    try:
        beta = np.linalg.solve(xx, xy)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    return max(float(yy - beta @ xy), 0.0), beta, xx


def _adf_of_gram(gram: np.ndarray, head: np.ndarray, n: int, max_lag: int) -> tuple[float, int]:
    """Lag with the best AIC on the common sample, then the t value on all rows that lag allows."""
    last, rows = max_lag + 2, n - 1 - max_lag
    aic = []
    for lag in range(max_lag + 1):
        ssr = _fit(gram, lag, last)[0]
        aic.append(rows * math.log(max(ssr, 1e-300) / rows) + 2 * (2 + lag))
    best = int(np.argmin(aic))
    keep = [*range(2 + best), last]
    cross = gram[np.ix_(keep, keep)].copy()
    if best < max_lag:
        extra = _design(head, best + 1, max_lag + 1, best)
        cross += extra.T @ extra
    ssr, beta, xx = _fit(cross, best, 2 + best)
    df = n - 1 - best - (2 + best)
    se = math.sqrt(ssr / df * np.linalg.pinv(xx)[1, 1])
    return float(beta[1] / se), best


def adf(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag by AIC up to 12 (n / 100)^(1/4).

    The regressions need only the cross products of their columns. Those are summed over
    blocks of rows; one small matrix per series is left for the choice of the lag. Scaling
    the series does not change the test and keeps the products well conditioned.
    """
    x = df.select(key, *order, F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    stats = x.groupBy(key).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    top = F.ceil(12.0 * F.pow(F.col("n") / 100, 0.25))
    rows = (join_few(numbered(x, [key], order, "pos").withColumnRenamed("pos_total", "n"), stats, key)
            .where((F.col("_s") > 0) & (F.col("n") >= 10))
            .select(key, "pos", "n", ((F.col("x") - F.col("_m")) / F.col("_s")).alias("y"),
                    F.least(top, F.floor(F.col("n") / 2) - 2).alias("lags")))
    size = F.greatest(F.col("lags") + 2, F.lit(BLOCK))
    blocks = halo_blocks(rows, "pos", size, F.col("lags") + 1, 0, total="n")
    kind = dict(df.dtypes)[key]

    def cross_products(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        y, pos = pdf["y"].to_numpy(), pdf["pos"].to_numpy()
        lags, n = int(pdf["lags"].iloc[0]), int(pdf["n"].iloc[0])
        own = np.flatnonzero(pdf["own"].to_numpy())
        start = max(int(own[0]), lags + 1 - int(pos[0]))
        z = _design(y, start, int(own[-1]) + 1, lags) if start <= own[-1] else np.zeros((0, lags + 3))
        head = y[:lags + 1] if pos[0] == 0 and own[0] == 0 else np.zeros(0)
        return pd.DataFrame({key: [group[0]], "n": [n], "lags": [lags],
                             "gram": [(z.T @ z).ravel()], "head": [head]})

    parts = grouped(blocks, key, "block").applyInPandas(
        cross_products, f"{key} {kind}, n bigint, lags bigint, gram array<double>, head array<double>")
    sums = parts.groupBy(key).agg(
        F.max("n").alias("n"), F.max("lags").alias("lags"), Summarizer.sum(array_to_vector("gram")).alias("g"),
        F.max_by("head", F.size("head")).alias("head")).withColumn("gram", vector_to_array("g")).drop("g")

    def test(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = int(row.lags) + 3
                tau, used = _adf_of_gram(np.asarray(row.gram).reshape(k, k), np.asarray(row.head), int(row.n), int(row.lags))
                out.append((getattr(row, key), int(row.n), used, tau, unit_root_p(tau)))
            yield pd.DataFrame(out, columns=[key, "n", "lags", "statistic", "p_value"])

    # few bytes but much work per series: even shares for all cores
    return sums.select(key, "n", "lags", "gram", "head").repartition(pieces(sums), F.xxhash64(key)).mapInPandas(
        test, f"{key} {kind}, n bigint, lags bigint, statistic double, p_value double") \
        .withColumn("stationary", F.col("p_value") < 0.05)


# ---- signals ---------------------------------------------------------------

def frames(df: DataFrame, key: str, order: Sequence[str], value: str, size: int) -> DataFrame:
    """Samples with position, previous sample, mean of the signal and frame number.

    Frames do not overlap; the last one may be shorter.
    """
    x = df.select(key, *order, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    s = scan(x, [key], order, running={"rank": F.lit(1).cast("bigint"), "c": "v"}, lag={"prev": "v"})
    pos = F.col("rank") - 1
    return s.select(key, pos.alias("pos"), "v", "prev", (F.col("c_total") / F.col("rank_total")).alias("signal_mean"),
                    F.floor(pos / size).alias("frame"))


def energy(framed: DataFrame, key: str) -> DataFrame:
    """Mean and population deviation of the root mean square of the frames."""
    rms = framed.groupBy(key, "frame").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return rms.groupBy(key).agg(F.avg("rms").alias("rms_mean"), F.stddev_pop("rms").alias("rms_std"))


def zero_crossings(framed: DataFrame, key: str, centered: bool = True) -> DataFrame:
    """Mean over the frames of the share of samples whose sign differs from the one before."""
    shift = F.col("signal_mean") if centered else F.lit(0.0)
    negative, before = (F.col("v") - shift) < 0, (F.col("prev") - shift) < 0
    crossed = F.when(F.col("prev").isNotNull() & (negative != before), 1.0).otherwise(0.0)
    rate = framed.groupBy(key, "frame").agg(F.avg(crossed).alias("zcr"))
    return rate.groupBy(key).agg(F.avg("zcr").alias("zcr_mean"))


def spectrum(framed: DataFrame, key: str, size: int, sample_rate: float = 1.0) -> DataFrame:
    """Mean over the frames of spectral centroid, bandwidth and 85 % rolloff.

    Each frame (at most ``size`` samples) is Hann-weighted and transformed on its own.
    """
    arrays = framed.groupBy(key, "frame").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("samples"))

    @F.pandas_udf("centroid double, bandwidth double, rolloff double")
    def measures(samples: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(samples), size))
        for i, s in enumerate(samples):
            x[i, :len(s)] = s
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        mag = np.abs(np.fft.rfft(x * window, axis=1))
        freq = np.fft.rfftfreq(size, 1 / sample_rate)
        total = mag.sum(axis=1)
        share = mag / np.where(total > 0, total, 1)[:, None]
        centroid = share @ freq
        bandwidth = np.sqrt((share * (freq[None, :] - centroid[:, None]) ** 2).sum(axis=1))
        reached = np.cumsum(mag, axis=1) >= 0.85 * total[:, None]
        return pd.DataFrame({"centroid": centroid, "bandwidth": bandwidth, "rolloff": freq[reached.argmax(axis=1)]})

    m = arrays.select(key, measures("samples").alias("m"))
    return m.groupBy(key).agg(*[F.avg(f"m.{c}").alias(f"spectral_{c}_mean")
                                for c in ("centroid", "bandwidth", "rolloff")])


def signal_features(df: DataFrame, key: str, order: Sequence[str], value: str, size: int) -> DataFrame:
    framed = frames(df, key, order, value, size)
    return (energy(framed, key).join(zero_crossings(framed, key), key).join(spectrum(framed, key, size), key))


AUDIO_FEATURES = ["rms_mean", "zcr_mean", "spectral_centroid_mean"]


def audio_drift(features: DataFrame) -> DataFrame:
    """(side, features) -> Wasserstein distance per feature and their mean as ``overall``."""
    scores = cut(wasserstein(to_long(features, AUDIO_FEATURES)))
    return scores.unionByName(scores.agg(F.avg("score").alias("score")).select(F.lit("overall").alias("attr"), "score"))
