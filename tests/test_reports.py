"""Envelopes, decisions and streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import decisions, envelopes
from plumbline.sources.envelopes import read_envelope_stream, read_envelopes
from plumbline.streaming import jobs

GOOD = {"protocol_version": "1.1", "sent_at": "2024-05-01T00:00:00Z", "source": {"app_id": "app-1", "app_type": "x"},
        "payload_kinds": ["decision_batch"], "decision_batch": [
            {"id": f"d{i}", "created_at": "2024-05-01", "decision_type": "match", "decision": "accept", "model_name": "m",
             "threshold_applied": 0.7, "scores": {"top": 0.91}, "trace": {}} for i in range(3)]}


def change(**kw):
    out = dict(GOOD, **kw)
    return {k: v for k, v in out.items() if v is not ...}


CASES = {
    "good": (GOOD, None),
    "protocol": (change(protocol_version="0.9"), "unsupported protocol_version"),
    "no_protocol": (change(protocol_version=...), "unsupported protocol_version"),
    "no_app": (change(source={"app_type": "x"}), "source.app_id is required"),
    "empty_app": (change(source={"app_id": ""}), "source.app_id is required"),
    "no_source": (change(source=...), "source.app_id is required"),
    "kinds_text": (change(payload_kinds="decision_batch"), "payload_kinds must be a list"),
    "no_kinds": (change(payload_kinds=None), None),
    "batch_object": (change(decision_batch={"a": 1}), "decision_batch must be a list"),
    "batch_null": (change(decision_batch=None), None),
    "row_text": (change(decision_batch=["x"]), "decision is not an object"),
    "no_decision": (change(decision_batch=[{"id": "1", "decision_type": "t"}]), "decision malformed"),
    "bad_threshold": (change(decision_batch=[{"id": "1", "decision_type": "t", "decision": "d", "threshold_applied": "high"}]), "decision malformed"),
    "drift": (change(payload_kinds=["drift_report"], drift_report={"severity": "high"}, decision_batch=...), None),
    "drift_list": (change(payload_kinds=["drift_report"], drift_report=[1]), "drift_report must be an object"),
    "text": ("{not json", "invalid json"),
    "list": ([1, 2], "invalid json"),
    "empty": ("", "invalid json"),
}


def files(spark, names=None):
    rows = [(f"{n}.json", v[0] if isinstance(v[0], str) else json.dumps(v[0])) for n, v in CASES.items() if names is None or n in names]
    return spark.createDataFrame(rows, "source_file string, content string")


def test_validate(spark):
    got = {r["source_file"][:-5]: r["reason"] for r in envelopes.validate(files(spark)).collect()}
    assert got == {n: v[1] for n, v in CASES.items()}


def test_decisions_rows(spark):
    p = envelopes.validate(files(spark, ["good", "drift"]))
    d = envelopes.decisions(p, envelopes.site_of(p), F.lit("now"))
    assert d.columns == envelopes.DECISION_COLUMNS
    row = d.where("id = 'd0'").first()
    assert row["threshold_applied"] == "0.7" and json.loads(row["scores_json"]) == {"top": 0.91}
    assert (row["trace_json"], row["inputs_ref_json"], row["site_id"], row["source_file"]) == ("", "", "app-1", "good.json")
    assert d.count() == 3
    reports = envelopes.drift_reports(p, envelopes.site_of(p, "here"), F.lit("now")).collect()
    assert [(r["source_file"], json.loads(r["report"]), r["site_id"]) for r in reports] == [("drift.json", {"severity": "high"}, "here")]


def test_manifest_and_site(spark):
    p = envelopes.validate(files(spark, ["good", "text", "protocol"]))
    assert tuple(envelopes.run_manifest(p).first()) == (3, 1, 2, 3, 0)
    assert envelopes.site_of(p.where("reason IS NOT NULL")).first()[0] == "default"
    nothing = envelopes.validate(files(spark).where("false"))
    assert tuple(envelopes.run_manifest(nothing).first()) == (0, 0, 0, 0, 0)


def write_folder(folder, names):
    folder.mkdir(exist_ok=True)
    for n in names:
        body = CASES[n][0]
        (folder / f"{n}.json").write_text(body if isinstance(body, str) else json.dumps(body, indent=1))


def test_whole_files_are_read(spark, tmp_path):
    write_folder(tmp_path / "in", ["good", "protocol"])
    p = envelopes.validate(read_envelopes(spark, str(tmp_path / "in")))
    assert {(r["source_file"], r["reason"]) for r in p.collect()} == {("good.json", None), ("protocol.json", "unsupported protocol_version")}


def test_ingest_stream_takes_each_file_once(spark, tmp_path):
    write_folder(tmp_path / "in", ["good", "text"])

    def run():
        stream = read_envelope_stream(spark, str(tmp_path / "in"), "keep")
        jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), site="s9")
        return spark.read.parquet(str(tmp_path / "out/manifest")).agg(F.sum("files_processed"), F.sum("files_skipped")).first()

    assert tuple(run()) == (1, 1)
    assert tuple(run()) == (1, 1)
    write_folder(tmp_path / "in", ["drift"])
    assert tuple(run()) == (2, 1)
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "out/decisions")).select("site_id").distinct().collect()} == {"s9"}
    assert spark.read.parquet(str(tmp_path / "out/drift_reports")).count() == 1


def test_ingest_modes(spark, tmp_path):
    with pytest.raises(ValueError):
        read_envelope_stream(spark, str(tmp_path), "copy")
    with pytest.raises(ValueError):
        read_envelope_stream(spark, str(tmp_path), "move")
    write_folder(tmp_path / "in", ["good"])
    stream = read_envelope_stream(spark, str(tmp_path / "in"), "delete")
    jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out/decisions")).count() == 3


# ---- decisions -------------------------------------------------------------

def report_frame(n=400, seed=0):
    rng = np.random.default_rng(seed)
    hours = np.sort(rng.integers(0, 24 * 20, n))  # many ties
    return pd.DataFrame({"id": np.arange(n), "agent_id": rng.integers(0, 3, n), "model_name": rng.choice(["yolo-1", "alpr", "x"], n),
                         "severity": rng.choice(["low", "medium", "high"], n, p=[.3, .5, .2]),
                         "created_at": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h")})


def brute_counts(pdf):
    m = pdf[pdf["severity"] == "medium"]
    out = {}
    for r in m.itertuples():
        same = m[(m["agent_id"] == r.agent_id) & (m["model_name"] == r.model_name)]
        out[r.id] = int(((same["created_at"] <= r.created_at) & (same["created_at"] >= r.created_at - pd.Timedelta(hours=48))).sum())
    return out


def test_escalation_counts(spark):
    pdf = report_frame()
    got = {r["id"]: r["n_recent"] for r in decisions.escalation_window(spark.createDataFrame(pdf)).collect()}
    assert got == brute_counts(pdf)


def trainers(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, trainer_type string, status string")


def test_match_trainer(spark):
    models = spark.createDataFrame([("my-ALPR-yolo",), ("yolo",), ("rt-DETR",), ("other",), (None,)], "model_name string")
    t = trainers(spark, [("1", "any", "x", "active"), ("2", "y", "yolo", "active"), ("3", "a", "alpr", "active"), ("0", "off", "yolo", "inactive")])
    got = {r["model_name"]: r["trainer_name"] for r in decisions.match_trainer(models, t).collect()}
    assert got == {"my-ALPR-yolo": "a", "yolo": "y", "rt-DETR": "y", "other": "any", None: "any"}
    got = {r["model_name"]: r["trainer_name"] for r in decisions.match_trainer(models, t.where("trainer_type <> 'alpr'")).collect()}
    assert got["my-ALPR-yolo"] == "y"
    assert decisions.match_trainer(models, t.where("false")).where("trainer_name IS NOT NULL").count() == 0


def test_decide(spark):
    pdf = report_frame()
    rep = spark.createDataFrame(pdf)
    counts = brute_counts(pdf)
    some = trainers(spark, [("1", "any", "x", "active")])
    for t, retrain in ((some, True), (some.where("false"), False)):
        got = {r["id"]: r for r in decisions.decide(rep, t).collect()}
        assert len(got) == len(pdf)
        for r in pdf.itertuples():
            want = "observe" if r.severity == "low" else "retrain" if retrain and (
                r.severity == "high" or counts[r.id] >= 3) else "alert"
            assert got[r.id]["action"] == want
            assert got[r.id]["report_status"] == ("action_taken" if want == "retrain" else want)


def test_escalation_stream_equals_batch(spark, tmp_path):
    pdf = report_frame(300, 4)
    df = spark.createDataFrame(pdf)
    for lo, hi in ((0, 100), (100, 200), (200, 300)):
        df.where((F.col("id") >= lo) & (F.col("id") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        jobs.escalation_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["id"]: r["n_recent"] for r in spark.read.parquet(str(tmp_path / "out/decisions")).collect()}
    assert got == brute_counts(pdf)
    # a report from long ago comes too late: dropped and counted
    late = df.where("id = 0").withColumn("id", F.lit(9999).cast("bigint")).withColumn("severity", F.lit("medium"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    jobs.escalation_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    progress = spark.read.parquet(str(tmp_path / "out/progress"))
    assert progress.agg(F.max("dropped")).first()[0] == 1
    assert progress.select("batch").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "out/decisions")).where("id = 9999").count() == 0


def test_escalation_stream_keeps_few_folders(spark, tmp_path):
    """Ten days in ten batches: the kept days and the progress stay few, the counts stay right."""
    start = pd.Timestamp("2024-03-01")
    pdf = pd.DataFrame([(k, 1, "m", "medium", start + pd.Timedelta(hours=6 * k)) for k in range(40)],
                       columns=["id", "agent_id", "model_name", "severity", "created_at"])
    df = spark.createDataFrame(pdf)
    for day in range(10):
        df.where(F.floor(F.col("id") / 4) == day).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        jobs.escalation_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert len(list((tmp_path / "out/recent").glob("day=*"))) <= 5 and len(list((tmp_path / "out/progress").glob("batch=*"))) <= 2
    got = {r["id"]: r["n_recent"] for r in spark.read.parquet(str(tmp_path / "out/decisions")).collect()}
    assert got == {k: min(k, 8) + 1 for k in range(40)}


def test_register_keeps_the_last_known_values(spark):
    m = spark.createDataFrame([("a", 1, 1, "x", "n1"), ("a", 2, 2, None, "n2"), ("a", 3, 3, None, None), ("b", 1, 4, None, None)],
                              "app string, ts int, o int, kind string, name string")
    got = {r["app"]: tuple(r) for r in decisions.latest_register(m, "app", "ts", ["kind", "name"], "o").collect()}
    assert got == {"a": ("a", "x", "n2", 3, "active"), "b": ("b", None, None, 1, "active")}


def test_baseline_monitor_sees_a_shift(spark, tmp_path):
    base = spark.range(1000).select((F.col("id") % 10).cast("double").alias("v"))
    for i, shift in enumerate((0, 20)):
        base.select((F.col("v") + shift).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.drift_monitor(spark.readStream.schema("v double").parquet(str(tmp_path / "in")), base, ["v"],
                           str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out/timeline")).orderBy("batch").collect()
    assert [r["n_rows"] for r in rows] == [1000, 1000]
    assert rows[0]["overall_score"] < 1e-9 and rows[0]["status"] == "NORMAL" and rows[1]["status"] == "CRITICAL"
