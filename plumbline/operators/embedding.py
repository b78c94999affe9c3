"""Drift between two sets of embeddings.

Input is (side, key, embedding). Everything but the exact kernel distance is linear
in the rows; that one is quadratic by definition and runs in tiles of bounded size. Its
linear counterpart, ``mmd_rff``, is another estimator: it is used where ``method`` asks
for it, never by the size of the input, and it states its standard error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..plans.binning import paired_histogram
from ..plans.frames import BASE, TARGET, grouped, one_row, to_long
from ..plans.scratch import cut
from . import drift

# rows of a block, and of the strips in which a task works through a pair of blocks
TILE_ROWS = 16_384
STRIP_ROWS = 2048
# blocks that a table has at least, unless they came below so many rows
LEAST_BLOCKS = 24
LEAST_ROWS = 1024
# columns that a sixteenth of a strip is worked through with at a time: 256 kB a matrix, so that the few matrices stay in the processor's cache
COLUMNS = 256
METHODS = ("exact", "random_features")


def side_means(emb: DataFrame, vector: Column | None = None) -> DataFrame:
    """One row: mean vector of each side."""
    v = array_to_vector(vector if vector is not None else F.col("embedding"))
    means = emb.select("side", v.alias("v")).groupBy("side").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    return means.agg(F.first(F.when(F.col("side") == BASE, F.col("m")), ignorenulls=True).alias("mb"),
                     F.first(F.when(F.col("side") == TARGET, F.col("m")), ignorenulls=True).alias("mt"))


def mean_distances(emb: DataFrame) -> DataFrame:
    """One row: mean shift, cosine distance (floor 0, no length gives 0) and its text variant."""
    m = side_means(emb)
    b, t = F.col("mb"), F.col("mt")
    lengths = V.norm(b) * V.norm(t)
    cosine = F.when(lengths == 0, F.lit(0.0)).otherwise(F.greatest(1 - V.dot(b, t) / lengths, F.lit(0.0)))
    return m.select((V.distance(b, t) / F.sqrt(F.size(b))).alias("mean_shift"), cosine.alias("cosine"),
                    (1 - V.dot(b, t) / (lengths + 1e-10)).alias("cosine_text"))


def wasserstein_projected(emb: DataFrame) -> DataFrame:
    """One row: Wasserstein distance of the mean component of each row."""
    x = emb.select("side", (V.total(F.col("embedding")) / F.size("embedding")).alias("projection"))
    return drift.wasserstein(to_long(x, ["projection"])).select(F.col("score").alias("wasserstein"))


def pairwise_cosine(emb: DataFrame) -> DataFrame:
    """One row: 1 - mean cosine over all cross pairs; 1 if a side is empty.

    The mean over pairs is the dot product of the two mean unit vectors.
    """
    m = side_means(emb, V.unit(F.col("embedding")))
    return m.select(F.coalesce(1 - V.dot(F.col("mb"), F.col("mt")), F.lit(1.0)).alias("score"))


# ---- kernel distance -------------------------------------------------------

def tiles(emb: DataFrame) -> DataFrame:
    """Each row once per block of rows, with the pair of blocks (i, j) it serves."""
    rows = emb.count()
    # also a small table is dealt out over a few hundred pairs of blocks, so that all cores have work and end together
    blocks = max(1, math.ceil(rows / TILE_ROWS), min(LEAST_BLOCKS, math.ceil(rows / LEAST_ROWS)))
    mine = F.pmod(F.xxhash64(F.col("side"), F.col("key")), F.lit(blocks)).cast("int")
    # single precision takes half the room in the shuffle and is widened in the task
    v = F.col("embedding") if dict(emb.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    return (emb.select("side", v.alias("embedding"), mine.alias("block"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))


def keyed(emb: DataFrame) -> DataFrame:
    """Rows with a key by which blocks are dealt: rows that share a key, or have none, but not the vector, lie in blocks of their own."""
    return emb.withColumn("key", F.xxhash64("side", "key", "embedding"))


def powers(gammas: Sequence[float], most: int = 16) -> list[tuple[int | None, int]]:
    """For each kernel width an earlier one and the whole power of its kernel that gives this one's; (None, 0) without one."""
    out: list[tuple[int | None, int]] = []
    for k, g in enumerate(gammas):
        times = [(g / h, i) for i, h in enumerate(gammas[:k]) if h > 0 and abs(g / h - round(g / h)) < 1e-12 and 1 <= round(g / h) <= most]
        out.append((min(times)[1], round(min(times)[0])) if times else (None, 0))
    return out


def matrix(vectors: pa.ChunkedArray) -> np.ndarray | None:
    """Vectors of one length, none of them null, as rows of a matrix; None without any."""
    if not len(vectors):
        return None
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) > 1 or lengths[0] is None:
        raise ValueError(f"vectors of one length needed, not of {lengths}")
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]).reshape(-1, lengths[0]).astype(np.float64)


def power(x: np.ndarray, times: int, out: np.ndarray) -> np.ndarray:
    """A whole power, multiplied out into ``out``; the first is x itself."""
    if times == 1:
        return x
    half = power(x, times // 2, out)
    square = np.multiply(half, half, out=out)
    return np.multiply(square, x, out=out) if times % 2 else square


def kernel_sums(a: np.ndarray, b: np.ndarray, gammas: Sequence[float], within: bool, clip: float | None = None,
                strip: int = STRIP_ROWS) -> tuple[list[float], int]:
    """For each width the sum of the kernel over the pairs of rows, and their number; ``within`` takes each pair of a once.

    Pairs are worked through in pieces of a sixteenth of ``strip`` rows by ``COLUMNS``, in the same few matrices. A kernel that is a power
    of a narrower one's is multiplied out of it, which differs in the last bits; its last product is summed and only kept for others.
    """
    gammas, strip = sorted(gammas), max(1, strip // 16)
    total, n, of = [0.0] * len(gammas), 0, powers(gammas)
    # a matrix for the exponents, which becomes that of the last exponential, one for each kernel that others are made of, one for the rest
    last = max((k for k, (base, _) in enumerate(of) if base is None), default=0)
    kept = [k for k in range(len(gammas)) if k != last and any(k == base for base, _ in of)]
    # against a row of zeros the minimum takes a third of the time that it takes against one number
    room, ones, zeros = np.empty((len(kept) + 2, strip * COLUMNS)), np.ones(strip * COLUMNS), np.zeros(COLUMNS)
    # one product gives -g (|x|^2 + |y|^2 - 2xy), the exponent of the last exponential
    g = next((g for g in gammas[last:] if g > 0), 1.0)
    left = np.column_stack([a * (2.0 * g), (a * a).sum(1) * -g, np.full(len(a), -g)])
    right = np.column_stack([b, np.ones(len(b)), (b * b).sum(1)])
    # columns of a piece lie together, which the product reads faster than rows turned on their side
    right = [np.ascontiguousarray(right[first:first + COLUMNS].T) for first in range(0, len(b), COLUMNS)]
    for at in range(0, len(a), strip):
        x = left[at:at + strip]
        for first in range(at - at % COLUMNS if within else 0, len(b), COLUMNS):
            y = right[first // COLUMNS]
            s = np.matmul(x, y, out=room[0, :len(x) * y.shape[1]].reshape(len(x), y.shape[1]))
            if clip is not None:
                np.clip(s, -g * clip, g * clip, out=s)
            else:
                np.minimum(s, zeros[:s.shape[1]], out=s)
            if within and first < at + len(x):
                s = s[at + np.arange(len(x))[:, None] < first + np.arange(s.shape[1])]
            s = s.ravel()
            n += s.size
            one = ones[:s.size]
            kernels = {k: room[1 + i, :s.size] for i, k in enumerate(kept)} | {last: s}
            for k, (base, times) in enumerate(of):
                e = kernels.get(k, room[-1, :s.size])
                if base is None:
                    exponent = s if gammas[k] == g else np.multiply(s, gammas[k] / g, out=e)
                    total[k] += float(np.exp(exponent, out=e) @ one)
                    continue
                whole = kernels[base]
                part = power(whole, max(1, times - 1 if times % 2 else times // 2), e)
                other = one if times == 1 else whole if times % 2 else part
                total[k] += float(part @ other)
                if k in kept:
                    np.multiply(part, other, out=e)
    return total, n


def standardized(emb: DataFrame) -> DataFrame:
    """Each side shifted and scaled by its own mean and population deviation."""
    v = emb.select("side", array_to_vector("embedding").alias("v"))
    s = v.groupBy("side").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select(
        "side", vector_to_array("s.mean").alias("_m"), vector_to_array("s.variance").alias("_v"),
        F.col("s.count").alias("_n"))
    # two rows, one per side
    joined = emb.join(F.broadcast(s), "side")
    scale = F.transform("_v", lambda x: F.sqrt(x * (F.col("_n") - 1) / F.col("_n")) + 1e-8)
    centred = F.zip_with("embedding", "_m", lambda x, m: x - m)
    return joined.withColumn("embedding", F.zip_with(centred, scale, lambda x, d: x / d)).drop("_m", "_v", "_n")


def mmd(emb: DataFrame, gammas: Sequence[float], standardize: str = "none", clip: float | None = None) -> DataFrame:
    """(gamma, mmd): kernel distance over all pairs of rows.

    Rows are hashed into blocks of about ``TILE_ROWS`` and each pair of blocks is one
    task, which works in pieces of a few MB and returns nothing but kernel sums. A
    row is copied once per block, so n / ``TILE_ROWS`` times: quadratic, as the definition
    is; ``mmd_rff`` is linear. ``standardize="per_set"`` and ``clip`` give the variant that
    scales each side by itself.
    """
    if standardize not in ("none", "per_set"):
        raise ValueError(f"unknown standardize {standardize!r}")
    # by the vectors as they came: scaled ones depend on the order of sums
    emb = keyed(emb)
    if standardize == "per_set":
        emb = standardized(emb)
    gammas = sorted(float(g) for g in gammas)
    strip = STRIP_ROWS

    def of_blocks(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        parts = {(block, side): matrix(rows["embedding"].filter(pc.and_(pc.equal(rows["block"], block), pc.equal(rows["side"], side))))
                 for block in {i, j} for side in (BASE, TARGET)}
        out = []
        pairs = [(BASE, BASE), (TARGET, TARGET), (BASE, TARGET)] + ([(TARGET, BASE)] if i != j else [])
        for s, t in pairs:
            kind, a, b = s if s == t else "cross", parts[i, s], parts[j, t]
            found, n = ([0.0] * len(gammas), 0) if a is None or b is None else kernel_sums(a, b, gammas, i == j and s == t, clip, strip)
            out += [{"gamma": g, "kind": kind, "k": k, "n": n} for g, k in zip(gammas, found)]
        return pa.Table.from_pylist(out)

    sums = grouped(tiles(emb), "i", "j").applyInArrow(of_blocks, "gamma double, kind string, k double, n bigint")

    def mean_of(kind: str) -> Column:
        hit = F.col("kind") == kind
        return F.sum(F.when(hit, F.col("k"))) / F.nullif(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    square = mean_of(BASE) + mean_of(TARGET) - 2 * mean_of("cross")
    return sums.groupBy("gamma").agg(F.coalesce(F.sqrt(F.greatest(square, F.lit(0.0))), F.lit(0.0)).alias("mmd"))


def mmd_rff(emb: DataFrame, gammas: Sequence[float], features: int = 2048, seed: int = 42) -> DataFrame:
    """(gamma, mmd, square, square_error) by random Fourier features (Rahimi and Recht 2007): linear in the rows.

    ``square`` is the squared distance before it is cut at 0 and rooted, the mean over the
    features; ``square_error`` is the standard error of that mean. The exact squared distance
    lies within four of them but for one draw of features in ten thousand.

    Every batch returns the sums of its features per side, at most two rows per gamma.
    The squared norms of the mean features are corrected to leave out pairs of a row
    with itself, as the exact form does.
    """
    dim = len(emb.select("embedding").first()[0])
    gammas = [float(g) for g in gammas]
    half = features // 2

    def partial(batches):
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((dim, half))
        for pdf in batches:
            for side, rows in pdf.groupby("side")["embedding"]:
                x = np.stack(rows.to_list()).astype(float)
                base = x @ w
                for g in gammas:
                    z = base * math.sqrt(2 * g)
                    phi = np.concatenate([np.cos(z), np.sin(z)], axis=1) / math.sqrt(half)
                    yield pd.DataFrame({"side": [side], "gamma": [g], "n": [len(x)], "phi": [phi.sum(0)]})

    sums = emb.select("side", "embedding").mapInPandas(partial, "side string, gamma double, n bigint, phi array<double>")
    per = sums.groupBy("gamma", "side").agg(F.sum("n").alias("n"), vector_to_array(
        Summarizer.sum(array_to_vector("phi"))).alias("phi"))
    both = per.groupBy("gamma").agg(*[
        F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True).alias(f"{c}_{s}")
        for s in (BASE, TARGET) for c in ("n", "phi")])

    def half_of(s: str, first: int) -> Column:
        return F.slice(F.col(f"phi_{s}"), first, half)

    def products(s: str, t: str) -> Column:
        """Per feature, its cosine and sine sums multiplied; a feature has length 1 in all."""
        return F.zip_with(F.zip_with(half_of(s, 1), half_of(t, 1), lambda a, b: a * b),
                          F.zip_with(half_of(s, half + 1), half_of(t, half + 1), lambda a, b: a * b), lambda a, b: (a + b) * half)

    def within(s: str) -> Column:
        n = F.col(f"n_{s}")
        # the diagonal adds exactly n
        return F.transform(products(s, s), lambda q: (q - n) / F.nullif(n * (n - 1), F.lit(0)))

    cross = F.transform(products(BASE, TARGET), lambda q: 2 * q / (F.col("n_base") * F.col("n_target")))
    each = F.zip_with(F.zip_with(within(BASE), within(TARGET), lambda a, b: a + b), cross, lambda a, b: a - b)
    squares = both.select("gamma", each.alias("each")).withColumn("square", V.total(F.col("each")) / half)
    spread = V.total(F.transform("each", lambda x: (x - F.col("square")) * (x - F.col("square")))) / (half - 1)
    return squares.select("gamma", F.coalesce(F.sqrt(F.greatest("square", F.lit(0.0))), F.lit(0.0)).alias("mmd"), "square",
                          F.sqrt(spread / half).alias("square_error"))


# Kernel widths of the multi-scale scores.
VISION_GAMMAS = [0.1, 0.5, 1.0, 2.0, 5.0]
TEXT_GAMMAS = [0.5, 1.0, 2.0]


def kernel(emb: DataFrame, gammas: Sequence[float], method: str, known: DataFrame | None = None, **options) -> DataFrame:
    """(gamma, mmd) by the method asked for; ``known`` holds those of the same rows, method and options, for these widths at least."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, known: {METHODS}")
    if known is not None:
        return known.where(F.col("gamma").isin([float(g) for g in gammas])).select("gamma", "mmd")
    if method == "exact":
        return mmd(emb, gammas, **options)
    if options.get("standardize") == "per_set":
        emb = standardized(emb)
    return mmd_rff(emb, gammas).select("gamma", "mmd")


def kernels_of_ensembles(emb: DataFrame, method: str = "exact") -> DataFrame:
    """(gamma, mmd) of all widths of the two ensembles, kept: one pass over the pairs for all scores that take them as ``known``."""
    return cut(kernel(emb, sorted({*VISION_GAMMAS, *TEXT_GAMMAS}), method))


def mmd_multiscale(emb: DataFrame, gammas: Sequence[float], method: str = "exact", known: DataFrame | None = None, **options) -> DataFrame:
    """One row: mean and population deviation over the kernel widths, from one pass over the pairs, and the method."""
    return kernel(emb, gammas, method, known, **options).agg(
        F.avg("mmd").alias("mmd_mean"), F.stddev_pop("mmd").alias("mmd_std"), F.lit(method).alias("mmd_method"))


# ---- principal components --------------------------------------------------

def pca_model(emb: DataFrame, k: int, column: str = "embedding"):
    return PCA(k=k, inputCol="v", outputCol="p").fit(emb.select(array_to_vector(F.col(column)).alias("v")))


def psi_pca(emb: DataFrame, fit_on: str = "base", fit_components: int = 10, score_components: int = 5) -> DataFrame:
    """(component, score): stability index of each principal component.

    Vision fits up to 10 components on the base and scores 5, the service 5 and 5, text
    fits 3 on both sides. Without a row to fit there is no component.
    """
    fit = emb if fit_on == "both" else emb.where(F.col("side") == BASE)
    one = fit.where(F.col("embedding").isNotNull()).select("embedding").first()
    if one is None:
        return emb.sparkSession.createDataFrame([], "component string, score double")
    k = min(fit_components, len(one[0]))
    model = pca_model(fit, k)
    names = [f"pc{i}" for i in range(min(score_components, k))]
    p = model.transform(emb.select("side", array_to_vector("embedding").alias("v"))).select(
        "side", vector_to_array("p").alias("p"))
    wide = p.select("side", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return drift.psi_of_counts(paired_histogram(to_long(wide, names), 10), 10).withColumnRenamed("attr", "component")


def psi_pca_row(emb: DataFrame, **options) -> DataFrame:
    return psi_pca(emb, **options).agg(F.avg("score").alias("psi_mean"), F.max("score").alias("psi_max"))


# ---- ensembles -------------------------------------------------------------

# Fixed values: (weight, scale) of each metric in the three ensembles; scores are min(x / scale, 1).
VISION_WEIGHTS = {"mmd_mean": (0.30, 0.5), "mean_shift": (0.25, 0.1), "wasserstein": (0.20, 1.0),
                  "psi_mean": (0.15, 0.25), "cosine": (0.10, 1.0)}
TEXT_WEIGHTS = {"cosine_text": (0.40, 1.0), "mmd_mean": (0.40, 0.3), "psi_mean": (0.20, 0.25)}
SERVICE_WEIGHTS = {"size_kl": (0.10, 0.5), "noise_kl": (0.10, 0.5), "sharpness_kl": (0.10, 0.5), "mmd": (0.25, 0.5),
                   "mean_shift": (0.20, 0.1), "wasserstein": (0.15, 1.0), "psi_mean": (0.10, 0.25)}


def scaled(metric: str, scale: float) -> Column:
    return F.least(F.col(metric) / scale, F.lit(1.0))


def weighted(weights: dict[str, tuple[float, float]]) -> Column:
    parts = [scaled(m, t) * w for m, (w, t) in weights.items()]
    return sum(parts[1:], parts[0])


def ensemble_vision(emb: DataFrame, method: str = "exact", known: DataFrame | None = None) -> DataFrame:
    row = one_row(mmd_multiscale(emb, VISION_GAMMAS, method, known), mean_distances(emb), wasserstein_projected(emb),
                  psi_pca_row(emb, fit_on="base", fit_components=10, score_components=5))
    return row.withColumn("ensemble", weighted(VISION_WEIGHTS))


def ensemble_text(emb: DataFrame, method: str = "exact", known: DataFrame | None = None) -> DataFrame:
    row = one_row(mmd_multiscale(emb, TEXT_GAMMAS, method, known), mean_distances(emb),
                  psi_pca_row(emb, fit_on="both", fit_components=3, score_components=3))
    return row.withColumn("ensemble", weighted(TEXT_WEIGHTS))


def service_scores(attributes: DataFrame, emb: DataFrame, method: str = "exact") -> DataFrame:
    """One row of the service metrics; ``attributes`` is the long form of size, noise and sharpness."""
    kl = drift.kl(attributes).agg(*[F.max(F.when(F.col("attr") == a, F.col("score"))).alias(f"{a}_kl")
                                    for a in ("size", "noise", "sharpness")])
    one = kernel(emb, [1.0], method, standardize="per_set", clip=50.0).select("mmd", F.lit(method).alias("mmd_method"))
    return one_row(kl, one, mean_distances(emb), wasserstein_projected(emb),
                   psi_pca_row(emb, fit_on="base", fit_components=5, score_components=5))


def ensemble_service(row: DataFrame) -> DataFrame:
    """Weighted mean over the metrics that are present in the row."""
    entries = F.map_from_arrays(F.array(*[F.lit(m) for m in SERVICE_WEIGHTS]), F.array(*[
        F.struct(F.lit(w).alias("w"), scaled(m, t).alias("s")) if m in row.columns
        else F.struct(F.lit(w).alias("w"), F.lit(None).cast("double").alias("s"))
        for m, (w, t) in SERVICE_WEIGHTS.items()]))
    present = F.filter(F.map_values(entries), lambda e: e["s"].isNotNull())
    top = F.aggregate(present, F.lit(0.0), lambda acc, e: acc + e["w"] * e["s"])
    weight = F.aggregate(present, F.lit(0.0), lambda acc, e: acc + e["w"])
    return row.withColumn("ensemble", F.coalesce(top / F.nullif(weight, F.lit(0.0)), F.lit(0.0)))
