"""The embedding queries without SQL: whole rows, their scores and stability indexes against numpy."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbline.functions.scalar import CRITICAL_AT, WARNING_AT
from plumbline.operators import embedding as E, fusion
from plumbline.queries import QUERIES, load_all

SF = "/root/testdata/sf0.001"
load_all()


def psi_of_components(fit, components):
    """Mean and greatest stability index of the first principal components, by the covariance of numpy."""
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    v = np.array(rows["embedding"].tolist(), float)
    base = (rows["label"] < 5).to_numpy()
    values, vectors = np.linalg.eigh(np.cov((v if fit == "both" else v[base]).T))
    scores = []
    for axis in vectors[:, np.argsort(-values)[:components]].T:
        x = v @ axis
        place = np.minimum(((x - x.min()) / (x.max() - x.min()) * 10).astype(int), 9)
        p, q = ((np.bincount(place[side], minlength=10) + 1) / (side.sum() + 10) for side in (base, ~base))
        scores.append(abs(((q - p) * np.log(q / p)).sum()))
    return np.mean(scores), max(scores)


def weighted(row, weights):
    return sum(w * min(row[m] / t, 1) for m, (w, t) in weights.items())


def level(score):
    return "NORMAL" if score < WARNING_AT else "WARNING" if score < CRITICAL_AT else "CRITICAL"


def row_of(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 1
    return rows[0].asDict()


@pytest.mark.parametrize("name, weights, fit, components", [
    ("ensemble_vision", E.VISION_WEIGHTS, "base", 5), ("ensemble_text", E.TEXT_WEIGHTS, "both", 3),
    ("ensemble_service", E.SERVICE_WEIGHTS, "base", 5), ("drift_advanced", E.SERVICE_WEIGHTS, "base", 5)])
def test_ensembles_return_their_score_and_index(spark, name, weights, fit, components):
    row, rest = row_of(spark, name), row_of(spark, f"{name}_rest")
    assert (row["psi_mean"], row["psi_max"]) == pytest.approx(psi_of_components(fit, components), abs=1e-6)
    assert row["ensemble"] == pytest.approx(weighted(row, weights))
    weight, scale = weights["psi_mean"]
    assert row["ensemble"] == pytest.approx(rest["rest"] + weight * min(row["psi_mean"] / scale, 1), abs=1e-4)
    if name == "drift_advanced":
        assert row["status"] == level(row["ensemble"]) and row["base_from_cache"] is False and row["target_from_cache"] is False


def test_overall_scores(spark):
    image, text = row_of(spark, "drift_image_overall"), row_of(spark, "drift_text_overall")
    for row, ensemble, parts in ((image, "ensemble_vision", (0.45, 0.55)), (text, "ensemble_text", (0.5, 0.5))):
        assert row["embedding_drift"] == pytest.approx(row_of(spark, ensemble)["ensemble"])
        assert row["overall_score"] == pytest.approx(parts[0] * row["attribute_drift"] + parts[1] * row["embedding_drift"])
        assert row["status"] == level(row["overall_score"])
    assert image["added"] > 0 and image["removed"] > 0


def test_every_detector_is_run(spark):
    got = {(r.modality, r.detector): r for r in QUERIES["drift_detector_select"](spark, SF).collect()}
    assert set(got) == {(m, d) for m in ("image", "text") for d in fusion.DETECTORS[m]}
    # text reads the index of both sides, pictures that of ten components, five of which count
    assert got["text", "psi"].embedding_drift == pytest.approx(psi_of_components("both", 3)[0], abs=1e-6)
    assert got["image", "psi"].embedding_drift == pytest.approx(psi_of_components("base", 5)[0], abs=1e-6)
    for modality in ("image", "text"):
        assert got[modality, "default"].embedding_drift == pytest.approx(got[modality, "ensemble"].embedding_drift)
        assert got[modality, "psi"].mmd_method is None and got[modality, "ensemble"].mmd_method == "exact"


@pytest.mark.parametrize("fit", ["base", "both"])
def test_no_component_without_a_row_to_fit(spark, fit):
    none = spark.createDataFrame([], "side string, embedding array<double>")
    assert E.psi_pca(none, fit_on=fit).collect() == []
    assert E.psi_pca_row(none, fit_on=fit).first().asDict() == {"psi_mean": None, "psi_max": None}
    target = spark.createDataFrame([("target", [1.0, 2.0])], none.schema)
    assert fit == "both" or E.psi_pca(target).collect() == []
