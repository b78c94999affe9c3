"""Envelopes, reports, registers and jobs made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from ..operators import decisions, envelopes
from ..plans.frames import r
from ..plans.scratch import cut, scratch_path

# ---- envelopes -------------------------------------------------------------

# Ten events make one envelope; eight of ten envelope kinds carry a fault or a special shape.
KIND = "CAST(floor(event_id / 10) AS BIGINT) % 10"
STAMP = "2024-02-01T00:00:00Z"


def event_envelopes(spark, sf):
    """(source_file, content) of protocol 1.1 envelopes, some of them broken."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    decision = F.struct(
        F.concat(F.lit("d"), k.cast("string")).alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.when(~((F.expr(KIND) == 7) & (k % 10 == 3)), F.col("event_type")).alias("decision_type"),
        F.when(F.col("value") > 50, "accept").otherwise("reject").alias("decision"),
        F.concat(F.lit("m-"), "event_type").alias("model_name"),
        F.when(k % 3 == 0, "1.2").alias("model_version"),
        F.when(k % 4 != 0, F.col("value") / 300).alias("threshold_applied"),
        F.struct(F.col("value").alias("overall")).alias("scores"),
        F.when(k % 2 == 0, F.struct(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("user")))
        .alias("inputs_ref"),
        F.when(k % 5 == 0, "ok").alias("result_summary"))
    n = F.floor(k / 10)
    # a batch holds the ten events of its number, never more
    batches = e.groupBy(n.alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", decision.alias("d")))).alias("rows"),
        F.max("value").alias("top"), F.max("user_id").alias("app"))
    kind = F.col("n") % 10
    batch = F.to_json(F.transform("rows", lambda x: x["d"]))
    source = F.when(kind == 2, F.lit('{"app_type":"x"}')).otherwise(
        F.concat(F.lit('{"app_id":"app'), F.col("app").cast("string"), F.lit('"}')))
    kinds = (F.when(kind == 3, '"decision_batch"').when(kind == 5, '["drift_report"]')
             .when(kind == 8, '["decision_batch","drift_report"]').otherwise('["decision_batch"]'))
    report = F.concat(F.lit('{"severity":"high","scores":{"overall":'), F.col("top").cast("string"), F.lit("}}"))
    content = F.concat(
        F.lit('{"protocol_version":"'), F.when(kind == 1, "0.9").otherwise("1.1"), F.lit('","source":'), source,
        F.lit(',"payload_kinds":'), kinds, F.lit(',"decision_batch":'),
        F.when(kind == 4, F.lit('{"a":1}')).when(kind == 5, F.lit("[]")).otherwise(batch),
        F.when(kind.isin(5, 8), F.concat(F.lit(',"drift_report":'), report)).otherwise(""),
        F.when(kind == 6, "").otherwise("}"))
    return batches.select(F.concat(F.lit("env_"), F.lpad(F.col("n").cast("string"), 12, "0"), F.lit(".json"))
                          .alias("source_file"), content.alias("content"))


# numbers over 12 digits are padded by cutting in SQL; the test tables stay far below
ENV = f"""env AS (SELECT floor(event_id / 10)::BIGINT AS n, floor(event_id / 10)::BIGINT % 10 AS kind, max(value) AS top,
 'app' || max(user_id) AS app, count(*) AS rows FROM events GROUP BY ALL),
f AS (SELECT *, 'env_' || lpad(n::VARCHAR, 12, '0') || '.json' AS source_file,
 CASE kind WHEN 6 THEN 'invalid json' WHEN 1 THEN 'unsupported protocol_version' WHEN 2 THEN 'source.app_id is required'
  WHEN 3 THEN 'payload_kinds must be a list' WHEN 4 THEN 'decision_batch must be a list'
  WHEN 7 THEN 'decision malformed' END AS reason FROM env)"""


def parsed(spark, sf):
    # the site and the rows are both read off the parsed envelopes: parse once
    return cut(envelopes.validate(event_envelopes(spark, sf)))


@query("envelope_validate", f"WITH {ENV} SELECT source_file, coalesce(reason, '') AS reason FROM f")
def envelope_validate(spark, sf):
    return parsed(spark, sf).select("source_file", F.coalesce("reason", F.lit("")).alias("reason"))


@query("envelope_decisions", f"""WITH {ENV}, s AS (SELECT arg_min(app, source_file) AS site_id FROM f WHERE reason IS NULL)
SELECT 'd' || event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, event_type AS decision_type,
 CASE WHEN value > 50 THEN 'accept' ELSE 'reject' END AS decision, 'm-' || event_type AS model_name,
 CASE WHEN event_id % 3 = 0 THEN '1.2' ELSE '' END AS model_version,
 CASE WHEN event_id % 4 <> 0 THEN format('{{:.6g}}', value / 300) ELSE '' END AS threshold_applied,
 '{{"overall":' || value::VARCHAR || '}}' AS scores_json,
 CASE WHEN event_id % 2 = 0 THEN '{{"user":"u/' || user_id || '"}}' ELSE '' END AS inputs_ref_json,
 CASE WHEN event_id % 5 = 0 THEN 'ok' ELSE '' END AS result_summary, '' AS trace_json,
 (SELECT site_id FROM s) AS site_id, '{STAMP}' AS ingested_at, source_file
FROM events JOIN f ON f.n = floor(event_id / 10)::BIGINT WHERE reason IS NULL AND kind <> 5""")
def envelope_decisions(spark, sf):
    p = parsed(spark, sf)
    return envelopes.decisions(p, envelopes.site_of(p), F.lit(STAMP))


@query("envelope_drift_reports", f"""WITH {ENV}, s AS (SELECT arg_min(app, source_file) AS site_id FROM f WHERE reason IS NULL)
SELECT source_file, '{STAMP}' AS ingested_at, round(top, 6) AS overall, 'high' AS severity, (SELECT site_id FROM s) AS site_id
FROM f WHERE kind IN (5, 8)""")
def envelope_drift_reports(spark, sf):
    p = parsed(spark, sf)
    d = envelopes.drift_reports(p, envelopes.site_of(p), F.lit(STAMP))
    return d.select("source_file", "ingested_at", "site_id", F.get_json_object("report", "$.severity").alias("severity"),
                    r(F.get_json_object("report", "$.scores.overall").cast("double")).alias("overall"))


@query("envelope_site", f"""WITH {ENV} SELECT 'from files' AS case_name, arg_min(app, source_file) AS site_id FROM f WHERE reason IS NULL
UNION ALL SELECT 'explicit', 'site-7' UNION ALL SELECT 'no valid file', 'default'""")
def envelope_site(spark, sf):
    p = parsed(spark, sf)
    cases = [("from files", envelopes.site_of(p)), ("explicit", envelopes.site_of(p, "site-7")),
             ("no valid file", envelopes.site_of(p.where("reason IS NOT NULL")))]
    out = None
    for name, df in cases:
        row = df.select(F.lit(name).alias("case_name"), "site_id")
        out = row if out is None else out.unionByName(row)
    return out


MANIFEST_SQL = f"""WITH {ENV} SELECT count(*) AS files_seen, count(*) FILTER (reason IS NULL) AS files_processed,
 count(*) FILTER (reason IS NOT NULL) AS files_skipped,
 CAST(coalesce(sum(rows) FILTER (reason IS NULL AND kind <> 5), 0) AS BIGINT) AS decision_rows,
 count(*) FILTER (kind IN (5, 8)) AS drift_reports FROM f"""


@query("ingest_manifest", MANIFEST_SQL)
def ingest_manifest(spark, sf):
    return envelopes.run_manifest(parsed(spark, sf))


@query("src_envelopes", MANIFEST_SQL)
def src_envelopes(spark, sf):
    from ..sources.envelopes import read_envelopes
    path = scratch_path(spark, "envelopes")
    event_envelopes(spark, sf).select("content").write.text(path)
    return envelopes.run_manifest(envelopes.validate(read_envelopes(spark, path, one_per_file=False)))


@query("sink_decisions", f"""WITH {ENV}, s AS (SELECT arg_min(app, source_file) AS site_id FROM f WHERE reason IS NULL),
d AS (SELECT 'd' || event_id AS id, event_type AS decision_type, CASE WHEN value > 50 THEN 'accept' ELSE 'reject' END AS decision, site_id, source_file
 FROM events JOIN f ON f.n = floor(event_id / 10)::BIGINT, s WHERE reason IS NULL AND kind <> 5)
SELECT format, d.* FROM d, (SELECT unnest(['csv', 'parquet']) AS format)""")
def sink_decisions(spark, sf):
    from ..sources.sinks import write_decisions
    p = parsed(spark, sf)
    path = scratch_path(spark, "decisions")
    write_decisions(envelopes.decisions(p, envelopes.site_of(p), F.lit(STAMP)), path)
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{path}/csv")
    parquet = spark.read.parquet(f"{path}/parquet")

    def rows(df, kind):
        return df.select(F.lit(kind).alias("format"), "id", "decision_type", "decision", "site_id", "source_file")
    return rows(csv, "csv").unionByName(rows(parquet, "parquet"))


# ---- reports ---------------------------------------------------------------

MODEL = """CASE event_type WHEN 'click' THEN 'ALPR-v2' WHEN 'view' THEN 'yolo-nano' WHEN 'purchase' THEN 'detr-base'
 WHEN 'error' THEN 'crnn-line' ELSE 'custom' END"""
SEVERITY = "CASE WHEN value >= 100 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END"
REPORTS = f"""rep AS (SELECT event_id AS id, user_id AS agent_id, {MODEL} AS model_name, {SEVERITY} AS severity,
 ts AS created_at, value FROM events)"""
COUNTED = f"""{REPORTS}, cnt AS (SELECT *, count(*) FILTER (severity = 'medium') OVER (PARTITION BY agent_id, model_name ORDER BY created_at
 RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND CURRENT ROW) AS n_recent FROM rep)"""


def reports(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("agent_id"), F.expr(MODEL).alias("model_name"),
        F.expr(SEVERITY).alias("severity"), F.col("ts").alias("created_at"))


TRAINERS = [("t1", "yolo-a", "yolo", "active"), ("t2", "alpr-a", "alpr", "inactive"),
            ("t3", "general", "general", "active"), ("t4", "yolo-b", "yolo", "active")]


def trainers(spark):
    return spark.createDataFrame(TRAINERS, "id string, name string, trainer_type string, status string")


@query("escalation_window", f"""WITH {COUNTED} SELECT id, n_recent, n_recent >= 3 AS escalate FROM cnt WHERE severity = 'medium'""")
def escalation_window(spark, sf):
    return decisions.escalation_window(reports(spark, sf))


def register(spark, *names: str):
    """Trainers in this order; the type is the name up to the dash, a name in brackets is inactive."""
    rows = [(f"t{i}", n.strip("()"), n.strip("()").split("-")[0], "inactive" if n.startswith("(") else "active") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id string, name string, trainer_type string, status string")


@query("match_trainer", f"""WITH {REPORTS} SELECT DISTINCT model_name, CASE WHEN model_name IN ('yolo-nano', 'detr-base') THEN 'yolo-a' ELSE 'zeta' END AS trainer_name,
 CASE WHEN model_name = 'ALPR-v2' THEN 'alpr-a' ELSE 'other' END AS second_name FROM rep""")
def match_trainer(spark, sf):
    rep = reports(spark, sf)
    # a trainer that is not active serves nobody; models without one of their own go to the first active one
    a = decisions.match_trainer(rep, register(spark, "(alpr-a)", "zeta", "yolo-a", "yolo-b"))
    b = decisions.match_trainer(rep, register(spark, "other", "alpr-a", "(yolo-a)")).withColumnRenamed("trainer_name", "second_name")
    return a.join(b, "model_name")


_ACTION = f"CASE WHEN severity = 'low' THEN 'observe' WHEN severity = 'high' OR n_recent >= 3 THEN 'retrain' ELSE 'alert' END"


@query("decide_action", f"""WITH {COUNTED} SELECT id, {_ACTION} AS action, CASE WHEN severity = 'low' THEN 'Low severity drift for ' || model_name || ' — observing'
 WHEN severity = 'high' THEN 'High severity drift for ' || model_name || ' — triggering retraining'
 WHEN n_recent >= 3 THEN 'Repeated medium severity drift for ' || model_name || ' (3+ in 48h) — escalating to retraining'
 ELSE 'Medium severity drift for ' || model_name || ' — alerting' END AS reason,
 CASE WHEN {_ACTION} = 'retrain' THEN 'yolo-a' ELSE '' END AS trainer_name FROM cnt""")
def decide_action(spark, sf):
    d = decisions.decide(reports(spark, sf), trainers(spark))
    return d.select("id", "action", "reason", F.coalesce("trainer_name", F.lit("")).alias("trainer_name"))


@query("report_status", f"""WITH {COUNTED}, a AS (SELECT model_name, {_ACTION} AS action,
 CASE WHEN severity = 'low' THEN 'observe' ELSE 'alert' END AS bare FROM cnt)
SELECT model_name, CASE WHEN action = 'retrain' THEN 'action_taken' ELSE action END AS status, bare AS status_without_trainers,
 count(*) AS n FROM a GROUP BY ALL""")
def report_status(spark, sf):
    rep = reports(spark, sf)
    a = decisions.decide(rep, trainers(spark)).select("id", "model_name", F.col("report_status").alias("status"))
    b = decisions.decide(rep, trainers(spark).where("false")).select("id", F.col("report_status").alias("status_without_trainers"))
    return a.join(b, "id").groupBy("model_name", "status", "status_without_trainers").agg(F.count("*").alias("n"))


@query("report_intake", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS agent_id,
 CASE WHEN user_id % 3 = 0 THEN '' WHEN event_id % 4 = 0 THEN 'low' ELSE 'high' END AS severity,
 CASE WHEN user_id % 3 = 0 THEN '' ELSE event_type END AS model_name,
 CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS drift_overall,
 CASE WHEN user_id % 3 = 0 THEN 'rejected' ELSE 'received' END AS status FROM events""")
def report_intake(spark, sf):
    e = table(spark, sf, "events")
    incoming = e.select("event_id", F.concat(F.lit("app"), F.col("user_id").cast("string")).alias("app_id"), F.to_json(F.struct(
        F.struct(F.when(F.col("event_id") % 4 != 0, "high").alias("severity"), F.col("event_type").alias("model_name"),
                 F.struct(F.col("value").alias("overall")).alias("scores")).alias("drift"))).alias("report"))
    agents = e.where("user_id % 3 <> 0").select(F.col("user_id").alias("id")).distinct() \
        .withColumn("app_id", F.concat(F.lit("app"), F.col("id").cast("string")))
    ok = decisions.report_intake(incoming, agents)
    bad = decisions.rejected_reports(incoming, agents).select(
        "event_id", F.lit(None).cast("bigint").alias("agent_id"), F.lit("").alias("severity"), F.lit("").alias("model_name"),
        F.lit(None).cast("double").alias("drift_overall"), F.lit("rejected").alias("status"))
    return ok.unionByName(bad)


@query("latest_heartbeat", """SELECT user_id AS app_id, arg_max(event_type, event_id) FILTER (event_id % 3 = 0) AS app_type,
 arg_max('v' || floor(value)::INTEGER, event_id) FILTER (event_id % 5 <> 0) AS display_name,
 max(ts) AS last_heartbeat, 'active' AS status FROM events GROUP BY user_id""")
def latest_heartbeat(spark, sf):
    m = table(spark, sf, "events").select(
        F.col("user_id").alias("app_id"), "ts", "event_id",
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("app_type"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("v"), F.floor("value").cast("string"))).alias("display_name"))
    return decisions.latest_register(m, "app_id", "ts", ["app_type", "display_name"], "event_id")


@query("reports_latest", f"""WITH {REPORTS} SELECT id, agent_id, severity, created_at FROM rep WHERE agent_id = 8 AND severity = 'medium'
ORDER BY created_at DESC, id LIMIT 50""")
def reports_latest(spark, sf):
    return decisions.latest(reports(spark, sf), "created_at", "id", 50, agent_id=8, severity="medium").select(
        "id", "agent_id", "severity", "created_at")


@query("agents_latest", "SELECT user_id AS agent_id, min(ts) AS created_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def agents_latest(spark, sf):
    a = table(spark, sf, "events").groupBy(F.col("user_id").alias("agent_id")).agg(F.min("ts").alias("created_at"))
    return a.orderBy(F.desc("created_at"), "agent_id")


# ---- jobs ------------------------------------------------------------------

JOB_STATUS = "CASE WHEN event_id % 6 = 0 THEN 'failed' WHEN value > 60 THEN 'completed' ELSE 'gate_failed' END"


def jobs(spark, sf):
    """Events as training jobs with their result."""
    result = F.expr("""CASE WHEN event_id % 7 = 0 THEN '{}' WHEN event_id % 7 = 1 THEN
      concat('{"acceptance":{"gate_passed":', CAST(value > 60 AS STRING), '}}')
      ELSE concat('{"acceptance":{"gate_passed":', CAST(value > 60 AS STRING), '},"model":{"size":', event_id, '}}') END""")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("trainer_id"), F.col("user_id").alias("field_agent_id"),
        F.expr(JOB_STATUS).alias("status"), result.alias("result"), F.col("ts").alias("created_at"))


@query("jobs_latest", f"""SELECT event_id AS id, event_type AS trainer_id, {JOB_STATUS} AS status, ts AS created_at FROM events
WHERE event_type = 'click' AND ({JOB_STATUS}) = 'completed' ORDER BY ts DESC, event_id LIMIT 50""")
def jobs_latest(spark, sf):
    return decisions.latest(jobs(spark, sf), "created_at", "id", 50, trainer_id="click", status="completed") \
        .select("id", "trainer_id", "status", "created_at")


@query("job_result", """SELECT j.event_id AS id, CASE WHEN r.value > 60 AND r.event_id % 7 <> 0 THEN 'completed' ELSE 'gate_failed' END AS status,
 CASE WHEN r.value > 60 AND r.event_id % 7 <> 0 THEN '' ELSE 'Model did not pass acceptance gate' END AS error, 1.0::DOUBLE AS progress
FROM events j JOIN events r ON r.event_id + 1 = j.event_id""")
def job_result(spark, sf):
    j = jobs(spark, sf)
    # each result belongs to the next job; the last one has no job, the first job no result
    results = j.select((F.col("id") + 1).alias("job_id"), "result")
    return decisions.job_result(j.drop("result"), results).select(
        "id", "status", F.coalesce("error", F.lit("")).alias("error"), "progress")


@query("model_stage", f"""SELECT event_id, {MODEL} AS model, CASE event_type WHEN 'click' THEN 'recognizer' WHEN 'error' THEN 'recognizer'
 WHEN 'signup' THEN 'both' ELSE 'detector' END AS stage, CASE event_type WHEN 'error' THEN 64 WHEN 'view' THEN 16 ELSE 32 END AS batch_size
FROM events""")
def model_stage(spark, sf):
    m = F.expr(MODEL)
    return table(spark, sf, "events").select(
        "event_id", m.alias("model"), decisions.model_stage(m).alias("stage"),
        F.get_json_object(decisions.default_params(m), "$.batch_size").cast("int").alias("batch_size"))


@query("deploy_gate", f"""SELECT event_id AS id, CASE WHEN reason = '' THEN 'deployed' ELSE 'skipped' END AS action, reason,
 CASE WHEN reason = '' AND user_id % 4 <> 0 THEN 'app' || user_id ELSE '' END AS target_app FROM
(SELECT event_id, user_id, CASE WHEN ({JOB_STATUS}) <> 'completed' THEN 'job status: ' || ({JOB_STATUS})
  WHEN event_id % 7 = 0 THEN 'quality_gate_failed' WHEN event_id % 7 = 1 THEN 'no_model_result' ELSE '' END AS reason FROM events)""")
def deploy_gate(spark, sf):
    agents = table(spark, sf, "events").where("user_id % 4 <> 0").select(F.col("user_id").alias("id")).distinct() \
        .withColumn("app_id", F.concat(F.lit("app"), F.col("id").cast("string")))
    d = decisions.deploy_gate(jobs(spark, sf), agents)
    return d.select("id", "action", F.coalesce("reason", F.lit("")).alias("reason"),
                    F.coalesce("target_app", F.lit("")).alias("target_app"))
