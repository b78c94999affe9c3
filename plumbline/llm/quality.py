"""Quality by Bradley-Terry ranking.

Each labelled good document is preferred to each labelled poor one. A document's strength is a
weighted sum of its features, and the probability that one is preferred to another is the
logistic function of the difference of their strengths; the weights minimise the mean logistic
loss over all pairs (Newton steps with a small ridge). The threshold is a quantile of the strengths
of the training documents: the share of poor ones among all labels. The score is the logistic
function of the distance from the threshold, shifted so that the threshold scores ``CUT``.

Features are shares of kinds of characters and words, taken from the whole text and from
nothing else. All labelled documents teach, in all their pairs, and pairs are never listed: what
a pair adds depends on the strengths of its two ends alone, so what a document gets from all documents
of the other label is a smooth function of its strength, made from their counts by strength (``BINS``
of width ``WIDTH``, each document shared by the nearest two, which is exact to 1e-5; strengths beyond the
last bin count as that one). A step is two passes over the features, which tasks return as sums.
The steps' matrix takes the products across labels from means over ``COARSE`` groups of like strength; that
changes the way to the optimum, not the optimum. All documents are scored in one pass without a shuffle.

Rows without id, label or text: a null text counts as empty, and empty texts are scored like
others; a null label or id teaches nothing. With labels of one kind only, all score 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..plans.scratch import discard, written
from .words import slices

RIDGE = 1e-3
STEPS = 30
BINS, WIDTH, COARSE = 4096, 1 / 32, 64
CUT = 0.3
FOLDS = 5
PIECE = 4 << 20

MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
FEATURES = len(MARKS) + 14


def held_out(id_col: str) -> Column:
    """The rows whose label is not learnt from: remainder 0 of CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(raw: bytes) -> np.ndarray:
    """Shares of marks, cases and words of a text; all zeros but the first if it is empty."""
    out = np.zeros(FEATURES)
    out[0] = 1.0
    if not raw:
        return out
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    space = seen[9:14].sum() + seen[32]
    share = [upper, lower, digits, seen[128:].sum(), space, seen[10], seen[:9].sum() + seen[14:32].sum() + seen[127]]
    out[1:8] = np.sqrt(np.array(share) / size)
    out[8:8 + len(MARKS)] = np.sqrt(seen[MARKS] / size)
    words = raw.split()
    n = len(words)
    if n:
        at = 8 + len(MARKS)
        distinct = len(set(words))
        out[at] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[at + 1] = distinct / n
        out[at + 2] = np.log(distinct) / np.log(n) if n > 1 else 1.0
        out[at + 3] = np.sqrt((size - space) / n) / 4
        out[at + 4] = np.log(n) / 10
        out[at + 5] = sum(map(bytes.isupper, words)) / n
    return out


def _sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``of`` (labels, features) gives for some of them, added up by position."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of(batch.column("label").to_numpy(), batch.column("f").flatten().to_numpy().reshape(-1, FEATURES))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

    each = rows.mapInArrow(part, "s array<double>").select(F.posexplode("s").alias("at", "x"))
    return np.array([r["x"] for r in each.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()])


def _by_strength(kernel: Callable[[np.ndarray], np.ndarray], mass: np.ndarray) -> np.ndarray:
    """For each bin the mean of ``kernel`` (strength of a document of the mass, less that of the bin)."""
    return np.convolve(kernel(np.arange(BINS - 1, -BINS, -1) * WIDTH), mass, "valid") / mass.sum()


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _step(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One Newton step of the weights over all pairs of a good and a poor document."""
    def placed(f: np.ndarray):
        z = (f - mean) / scale
        return z, np.clip((z @ weights) / WIDTH + BINS / 2, 0, BINS - 1.001)

    def spread(label: np.ndarray, f: np.ndarray) -> np.ndarray:
        _, at = placed(f)
        low = at.astype(np.int64)
        cell = label * BINS + low
        return (np.bincount(cell, 1 - (at - low), minlength=2 * BINS) + np.bincount(cell + 1, at - low, minlength=2 * BINS))[:2 * BINS]

    mass = _sums(rows, spread).reshape(2, BINS)
    # the chance of the wrong order with a document of the other label, and its slope, by strength
    wrong = np.stack([_by_strength(lambda d: _logistic(-d), mass[1]), _by_strength(_logistic, mass[0])])
    bend = np.stack([_by_strength(lambda d: _logistic(d) * _logistic(-d), mass[1 - k]) for k in (0, 1)])
    share = np.cumsum(mass.sum(axis=0)) / mass.sum()
    group = np.minimum((share * COARSE).astype(np.int64), COARSE - 1)
    share_of = 1.0 / counts

    def moments(label: np.ndarray, f: np.ndarray) -> np.ndarray:
        z, at = placed(f)
        bins = np.arange(BINS)
        sign = np.where(label == 1, 1.0, -1.0)
        pull = np.where(label == 1, np.interp(at, bins, wrong[1]), np.interp(at, bins, wrong[0])) * share_of[label]
        curve = np.where(label == 1, np.interp(at, bins, bend[1]), np.interp(at, bins, bend[0])) * share_of[label]
        member = np.zeros((len(z), 2 * COARSE))
        member[np.arange(len(z)), label * COARSE + group[(at + 0.5).astype(np.int64)]] = 1.0
        near = member.T @ np.column_stack([z, np.ones(len(z)), at * WIDTH])
        return np.concatenate([z.T @ (pull * sign), ((z * curve[:, None]).T @ z).ravel(), near.ravel()])

    found = _sums(rows, moments)
    slope, curve, near = np.split(found, [FEATURES, FEATURES + FEATURES ** 2])
    near = near.reshape(2, COARSE, FEATURES + 2)
    strength = near[:, :, -1] / np.maximum(near[:, :, -2], 1)
    between = strength[1][:, None] - strength[0][None, :]
    across = near[1, :, :FEATURES].T @ (_logistic(between) * _logistic(-between)) @ near[0, :, :FEATURES] * share_of[0] * share_of[1]
    curve = curve.reshape(FEATURES, FEATURES) - across - across.T + RIDGE * np.eye(FEATURES)
    sizes, axes = np.linalg.eigh((curve + curve.T) / 2)
    return axes @ ((axes.T @ (slope - RIDGE * weights)) / np.maximum(sizes, RIDGE))


def _threshold(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, counts: np.ndarray, share_poor: float) -> float:
    """The strength below which the share of poor documents lies, each label having its share; half way to the next strength."""
    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").flatten().to_numpy().reshape(-1, FEATURES)
            found = ((f - mean) / scale) @ weights
            # from -1 to 1 in the same order
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found / (1 + np.abs(found)))], ["label", "u"])

    u = rows.mapInArrow(strengths, "label int, u double")
    low, width, below = -1.0, 2 / BINS, np.zeros(2)
    for _ in range(3):  # each pass looks into the bin that the last one found
        at = F.floor((F.col("u") - low) / width)
        bins = (u.where((at >= 0) & (at < BINS)).groupBy(at.alias("bin")).agg(F.count_if(F.col("label") == 0).alias("poor"), F.count_if(F.col("label") == 1).alias("good"))
                .orderBy("bin").collect())
        place = 0
        for r in bins:
            upto = below + (r["poor"], r["good"])
            place = r["bin"]
            if share_poor * (upto[0] / counts[0]) + (1 - share_poor) * (upto[1] / counts[1]) >= share_poor:
                break
            if r is not bins[-1]:
                below = upto
        low, width = low + place * width, width / BINS
    here, after = low + width * BINS / 2, u.where(F.col("u") > low + width * BINS).agg(F.min("u")).first()[0]

    def back(x: float) -> float:
        return x / (1 - abs(x))

    return (back(here) + back(after)) / 2 if after is not None else back(here)


def fit(rows: DataFrame, share_poor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(mean, scale, weights, threshold) from (label, f), the features of all preferred and other documents."""
    total = _sums(rows, lambda label, f: np.concatenate([[(label == 0).sum(), (label == 1).sum()], f.sum(axis=0), (f * f).sum(axis=0)]))
    counts = total[:2]
    if not counts.size or not counts.all():
        return None
    # rounded, so that sums in another order give the same model
    mean = np.round(total[2:2 + FEATURES] / counts.sum(), 9)
    scale = np.round(np.sqrt(np.maximum(total[2 + FEATURES:] / counts.sum() - mean ** 2, 0)), 9)
    scale[scale < 1e-6] = 1.0
    weights = np.zeros(FEATURES)
    for _ in range(STEPS):
        step = _step(rows, mean, scale, weights, counts)
        weights = weights + step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    weights = np.round(weights, 6)
    return mean, scale, weights, round(_threshold(rows, mean, scale, weights, counts, share_poor), 9)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """The fitted model, or None where the labels that may be learnt from are not of both kinds."""
    usable = (labels.where(~held_out(id_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
              .where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(iter([batch]), "raw", PIECE):
                found = [features(x or b"") for x in piece.column("raw").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(found, pa.list_(pa.float64()))], ["id", "f"])

    # features are far smaller than texts, so they meet the labels and not the texts
    texts = docs.where(~held_out(id_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("raw")).where("id IS NOT NULL")
    taken = texts.mapInArrow(measure, StructType([texts.schema["id"], StructField("f", ArrayType(DoubleType()))]))
    rows = written(taken.join(usable, "id").select("label", "f"), "quality")
    try:
        return fit(rows, counts[0] / (counts[0] + counts[1]))
    finally:
        discard(rows)


def scored(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, score): every row of the input as a struct, with its score from 0 to 1."""
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_cut = np.log(CUT / (1 - CUT))
        mean, scale, weights, threshold = model or (0.0, 1.0, np.zeros(FEATURES), at_cut)
        shift = at_cut - threshold
        for batch in batches:
            sized = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("raw")], ["row", "raw"])
            for piece in slices(iter([sized]), "raw", PIECE):
                found = np.array([features(x or b"") for x in piece.column("raw").to_pylist()]).reshape(-1, FEATURES)
                strength = np.clip(((found - mean) / scale) @ weights + shift, -500, 500)
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(1 / (1 + np.exp(-strength)))], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    return rows.mapInArrow(rate, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows that score at least ``CUT``, with all their columns."""
    return scored(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col).where(F.col("score") >= CUT).select("row.*")
