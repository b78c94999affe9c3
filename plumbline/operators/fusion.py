"""Whole drift results: per modality, chosen detector, fusion, baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import status_label
from ..functions.text import ATTRIBUTES
from ..plans.frames import one_row, to_long
from . import compare, drift, embedding


def image_overall(attributes: DataFrame, emb: DataFrame, base_keys: DataFrame, target_keys: DataFrame,
                  key: str, method: str = "exact") -> DataFrame:
    """.45 attribute mean + .55 embedding ensemble, status and file counts."""
    attr = drift.image_attribute_drift(attributes).where("attr = 'overall'").select(F.col("score").alias("attribute_drift"))
    emb_row = embedding.ensemble_vision(emb, method).select(F.col("ensemble").alias("embedding_drift"), "mmd_method")
    counts = compare.added_removed(base_keys, target_keys, key)
    row = one_row(attr, emb_row, counts)
    score = 0.45 * F.col("attribute_drift") + 0.55 * F.col("embedding_drift")
    return row.withColumn("overall_score", score).withColumn("status", status_label(F.col("overall_score")))


def text_overall(attributes: DataFrame, emb: DataFrame | None = None, method: str = "exact") -> DataFrame:
    """Mean of the seven relative distances; half of it is the embedding score, 0 without embeddings."""
    attr = drift.wasserstein_relative(to_long(attributes, ATTRIBUTES)).agg(F.avg("score").alias("attribute_drift"))
    if emb is None:
        row = attr.withColumn("embedding_drift", F.lit(0.0)).withColumn("mmd_method", F.lit(None).cast("string"))
    else:
        row = one_row(attr, embedding.ensemble_text(emb, method).select(F.col("ensemble").alias("embedding_drift"), "mmd_method"))
    return row.withColumn("overall_score", 0.5 * F.col("attribute_drift") + 0.5 * F.col("embedding_drift")) \
        .withColumn("status", status_label(F.col("overall_score")))


#: Columns of the embedding metrics in a result without embeddings.
_ABSENT = {"mmd": "double", "mmd_method": "string", "mean_shift": "double", "cosine": "double", "cosine_text": "double",
           "wasserstein": "double", "psi_mean": "double", "psi_max": "double"}


def advanced(attributes: DataFrame, emb: DataFrame, cached: tuple[bool, bool] = (False, False),
             minimum: int = 5, method: str = "exact") -> DataFrame:
    """Attribute scores, embedding metrics and ensemble.

    Either half needs at least ``minimum`` rows on each side, embeddings and attribute rows
    alike; where it has fewer, its columns are null and the ensemble leaves it out.
    """
    def fewest(df: DataFrame):
        counted = df.groupBy("side").count().agg(F.count("*").alias("sides"), F.min("count").alias("rows")).first()
        return counted["rows"] if counted["sides"] == 2 else 0

    values = attributes.groupBy("side", "attr").count().groupBy("side").agg(F.max("count").alias("n"))
    counted = values.agg(F.count("*").alias("sides"), F.min("n").alias("n")).first()
    with_attributes = counted["sides"] == 2 and counted["n"] >= minimum
    enough = fewest(emb) >= minimum
    attributes = attributes if with_attributes else attributes.where(F.lit(False))
    if enough:
        row = embedding.service_scores(attributes, emb, method)
    else:
        row = drift.kl(attributes).agg(*[F.max(F.when(F.col("attr") == a, F.col("score"))).alias(f"{a}_kl")
                                         for a in ("size", "noise", "sharpness")])
        row = row.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in _ABSENT.items()])
    return (embedding.ensemble_service(row).withColumn("has_embeddings", F.lit(enough)).withColumn("has_attributes", F.lit(with_attributes))
            .withColumn("base_from_cache", F.lit(cached[0])).withColumn("target_from_cache", F.lit(cached[1]))
            .withColumn("status", status_label(F.col("ensemble"))))


# ---- detectors -------------------------------------------------------------

class UnsupportedDetector(ValueError):
    code = "unsupported_detector"


# Detector names per modality and the metric each of them stands for.
DETECTORS = {
    "image": {"default": "ensemble", "ensemble": "ensemble", "mmd": "mmd_mean", "mean_shift": "mean_shift",
              "wasserstein": "wasserstein", "psi": "psi_mean", "cosine": "cosine"},
    "text": {"default": "ensemble", "mmd": "ensemble", "ensemble": "ensemble", "cosine": "cosine_text",
             "mmd_only": "mmd_mean", "psi": "psi_mean"},
    "audio": {"default": "wasserstein", "wasserstein": "wasserstein"},
    "timeseries": {"default": "moments", "moments": "moments"},
}


def resolve_detector(modality: str, name: str) -> str:
    """The metric behind a detector name; an unknown one is refused before any job runs."""
    known = DETECTORS.get(modality, {})
    if name not in known:
        raise UnsupportedDetector(f"unsupported_detector: {name!r} for {modality!r}, known: {sorted(known)}")
    return known[name]


def embedding_drift(emb: DataFrame, modality: str, detector: str = "default", method: str = "exact", known: DataFrame | None = None) -> DataFrame:
    """(modality, detector, metric, embedding_drift, mmd_method); the method is null where no kernel is in the score.

    ``known`` are the kernel distances of the same rows and method (``embedding.kernels_of_ensembles``), for several detectors.
    """
    metric = resolve_detector(modality, detector)
    if modality not in ("image", "text"):
        raise UnsupportedDetector(f"unsupported_detector: {modality!r} has no embeddings")
    if metric in ("mean_shift", "cosine", "cosine_text"):
        row = embedding.mean_distances(emb)
    elif metric == "wasserstein":
        row = embedding.wasserstein_projected(emb)
    elif metric == "psi_mean":
        options = {"fit_on": "both", "fit_components": 3, "score_components": 3} if modality == "text" else {}
        row = embedding.psi_pca_row(emb, **options)
    elif metric == "mmd_mean":
        row = embedding.mmd_multiscale(
            emb, embedding.TEXT_GAMMAS if modality == "text" else embedding.VISION_GAMMAS, method, known)
    else:
        row = embedding.ensemble_text(emb, method, known) if modality == "text" else embedding.ensemble_vision(emb, method, known)
    return row.select(F.lit(modality).alias("modality"), F.lit(detector).alias("detector"),
                      F.lit(metric).alias("metric"), F.col(metric).alias("embedding_drift"),
                      F.lit(method if metric in ("mmd_mean", "ensemble") else None).cast("string").alias("mmd_method"))


# ---- fusion ----------------------------------------------------------------

def parse_weights(spec: str | None) -> dict[str, float]:
    out: dict[str, float] = {}
    for item in filter(None, (part.strip() for part in (spec or "").split(","))):
        name, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"expected name=weight, got {item!r}")
        out[name.strip()] = float(value)
    return out


def fuse(results: DataFrame, strategy: str, weights: dict[str, float] | None = None, run: str = "run") -> DataFrame:
    """(run, modality, overall_score, status) -> one fused score per run.

    Results in error are left out; with fewer than two there is no fused score, and a
    single modality stands for itself. Weights of modalities a run does not have are
    ignored and listed in ``ignored_weights``.
    """
    if strategy not in ("none", "weighted", "max", "joint"):
        raise ValueError(f"unknown fusion {strategy!r}")
    s = F.col("overall_score")
    ok = results.where(s.isNotNull() & ~F.col("status").eqNullSafe("error"))
    w: Column = F.lit(1.0)
    if strategy == "weighted" and weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(F.try_element_at(given, F.col("modality")), F.lit(0.0))
    clamped = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    total = F.sum(w)
    by_strategy = {
        "weighted": F.when(total > 0, F.sum(w * s) / total).otherwise(F.avg(s)),
        "max": F.max(s),
        # 1 - product of (1 - s) by logarithms; a score of 1 makes it 1
        "joint": F.when(F.max(clamped) >= 1, F.lit(1.0)).otherwise(
            1 - F.exp(F.sum(F.when(clamped < 1, F.log1p(-clamped))))),
        "none": F.lit(None).cast("double")}
    n = F.count("*")
    out = ok.groupBy(run).agg(
        n.alias("n_modalities"), F.when(n >= 2, by_strategy[strategy]).alias("fused_score"),
        F.max_by("modality", F.struct(s, F.col("modality"))).alias("top_modality"),
        F.when(n == 1, F.max(s)).alias("single_score"),
        # at most one entry per modality
        F.array_join(F.array_sort(F.array_except(
            F.array(*[F.lit(k) for k in (weights or {})]).cast("array<string>"), F.collect_set("modality"))), ",")
        .alias("ignored_weights"))
    return out.withColumn("strategy", F.lit(strategy))


def drift_or_baseline(emb: DataFrame, base_id: str, target_id: str, cache, detector: str = "default") -> DataFrame:
    """Score a snapshot pair; a snapshot against itself without a baseline becomes the baseline."""
    if base_id == target_id and not cache.exists(base_id, "baseline"):
        cache.save(emb.drop("side"), base_id, "baseline", base_id)
        return emb.agg(F.lit("BASELINE_CREATED").alias("status"), F.lit(0.0).alias("overall_score"),
                       F.count("*").alias("n_rows"))
    scored = embedding_drift(emb, "image", detector)
    return one_row(scored.select(F.col("embedding_drift").alias("overall_score")), emb.agg(F.count("*").alias("n_rows"))) \
        .select(status_label(F.col("overall_score")).alias("status"), "overall_score", "n_rows")
