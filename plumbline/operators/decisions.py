"""Registers, drift reports and what to do about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.frames import micros, with_scalars
from ..plans.ordered import scan

# How many medium reports within how many hours lead to retraining,
# model name keywords with the trainer type they ask for, and the stage keywords.
ESCALATION_COUNT = 3
ESCALATION_HOURS = 48
TRAINER_KEYWORDS = [("alpr", "alpr"), ("yolo", "yolo"), ("detr", "yolo")]
RECOGNIZER_WORDS = "recognizer|crnn|alpr"
DETECTOR_WORDS = "detector|yolo|detr"


def trailing_counts(events: DataFrame, keys: Sequence[str], ts: str, row_id: str, hours: float) -> DataFrame:
    """(row_id, n): events of the same keys in the window [ts - hours, ts], both ends included.

    A range window would hold a busy key in one task. Instead every event enters a
    running count over range chunks, together with two reading points, at the end and
    just before the start of its window; n is the difference of the readings.
    """
    at = micros(events, ts)
    start = at - int(hours * 3600 * 1_000_000)
    points = F.array(
        F.struct(start.alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("enters")),
        F.struct(at.alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("enters")),
        F.struct(at.alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("enters")))
    lines = events.select(*keys, row_id, F.explode(points).alias("_p")).select(*keys, row_id, "_p.*")
    counted = scan(lines, keys, ["at", "kind", row_id], running={"c": F.col("enters").cast("bigint")})
    reading = F.when(F.col("kind") == 2, F.col("c")).when(F.col("kind") == 0, -F.col("c"))
    return counted.groupBy(row_id).agg(F.sum(reading).alias("n"))


def escalation_window(reports: DataFrame, hours: float = ESCALATION_HOURS,
                      count: int = ESCALATION_COUNT) -> DataFrame:
    """(id, agent_id, model_name, severity, created_at) -> the medium reports with their trailing count."""
    medium = reports.where(F.col("severity") == "medium")
    n = trailing_counts(medium, ["agent_id", "model_name"], "created_at", "id", hours)
    return n.select("id", F.col("n").alias("n_recent"), (F.col("n") >= count).alias("escalate"))


def match_trainer(models: DataFrame, trainers: DataFrame) -> DataFrame:
    """(model_name, trainer_name): by keyword among the active trainers, else the first active one.

    Works on distinct model names; the first trainer is the one with the smallest id.
    """
    active = trainers.where(F.col("status") == "active")
    names = models.select("model_name").distinct()
    wanted = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("word"), F.lit(t).alias("trainer_type"))
                       for i, (k, t) in enumerate(TRAINER_KEYWORDS)])
    lower = F.lower(F.coalesce("model_name", F.lit("unknown")))
    asked = names.select("model_name", F.explode(
        F.filter(wanted, lambda w: F.contains(lower, w["word"]))).alias("w")).select("model_name", "w.rank", "w.trainer_type")
    hits = asked.join(active.select("trainer_type", "id", "name"), "trainer_type").groupBy("model_name").agg(
        F.min_by("name", F.struct("rank", "id")).alias("_hit"))
    fallback = active.agg(F.min_by("name", "id").alias("_any"))
    out = with_scalars(names.withColumnRenamed("model_name", "_m")
                       .join(hits, F.col("_m").eqNullSafe(F.col("model_name")), "left"), fallback)
    return out.select(F.col("_m").alias("model_name"), F.coalesce("_hit", "_any").alias("trainer_name"))


def decide(reports: DataFrame, trainers: DataFrame) -> DataFrame:
    """Reports with ``action``, ``reason``, ``trainer_name`` and ``report_status``."""
    # the matching table has one row per model name; rename to join null-safe
    match = match_trainer(reports, trainers).withColumnRenamed("model_name", "_m")
    joined = (reports.join(escalation_window(reports), "id", "left")
              .join(match, F.col("model_name").eqNullSafe(F.col("_m")), "left").drop("_m"))
    severity = F.coalesce("severity", F.lit("low"))
    model = F.coalesce("model_name", F.lit("unknown"))
    trainer = F.col("trainer_name").isNotNull()
    escalated = F.coalesce("escalate", F.lit(False))
    low, high = severity == "low", severity == "high"
    action = (F.when(low, "observe").when((high | escalated) & trainer, "retrain").otherwise("alert"))

    def text(what: str, tail: str) -> Column:
        return F.concat(F.lit(f"{what} severity drift for "), model, F.lit(tail))

    # fixed values: the sentences of the reasons
    reason = (F.when(low, text("Low", " — observing"))
              .when(high & trainer, text("High", " — triggering retraining"))
              .when(high, text("High", " — no trainer registered, alerting"))
              .when(escalated & trainer, text("Repeated medium", f" ({ESCALATION_COUNT}+ in {ESCALATION_HOURS}h)"
                                              " — escalating to retraining"))
              .otherwise(text("Medium", " — alerting")))
    out = joined.withColumn("action", action).withColumn("reason", reason)
    return (out.withColumn("trainer_name", F.when(F.col("action") == "retrain", F.col("trainer_name")))
            .withColumn("report_status", F.when(F.col("action") == "retrain", "action_taken").otherwise(F.col("action"))))


# ---- registers and jobs ----------------------------------------------------

def report_intake(incoming: DataFrame, agents: DataFrame) -> DataFrame:
    """(app_id, report) -> report rows of registered agents."""
    j = F.col("report")
    known = agents.select("app_id", F.col("id").alias("agent_id"))
    return incoming.join(known, "app_id").select(
        *[c for c in incoming.columns if c not in ("app_id", "report")], "agent_id",
        F.coalesce(F.get_json_object(j, "$.drift.severity"), F.lit("low")).alias("severity"),
        F.get_json_object(j, "$.drift.model_name").alias("model_name"),
        F.get_json_object(j, "$.drift.scores.overall").try_cast("double").alias("drift_overall"),
        F.lit("received").alias("status"))


def rejected_reports(incoming: DataFrame, agents: DataFrame) -> DataFrame:
    return incoming.join(agents.select("app_id"), "app_id", "left_anti")


def latest_register(messages: DataFrame, key: str, ts: str, columns: Sequence[str], order: str) -> DataFrame:
    """Upserts and heartbeats folded per key: the last non-null value of each column, last seen time.

    ``order`` breaks ties of the time. An aggregation merges before its shuffle, so that
    an agent with very many messages is no problem.
    """
    when = F.struct(ts, order)
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns]
    return messages.groupBy(key).agg(*newest, F.max(ts).alias("last_heartbeat"), F.lit("active").alias("status"))


def latest(df: DataFrame, ts: str, key: str, limit: int = 50, **equal: object) -> DataFrame:
    """Rows with the given values, newest first."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.orderBy(F.desc(ts), key).limit(limit)


def job_result(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, result) applied to the jobs: status, error, progress."""
    passed = F.coalesce(F.get_json_object("result", "$.acceptance.gate_passed") == "true", F.lit(False))
    return (jobs.drop("status", "error", "progress").join(results, jobs["id"] == results["job_id"]).drop("job_id")
            .withColumn("status", F.when(passed, "completed").otherwise("gate_failed"))
            # fixed value: the text of the error
            .withColumn("error", F.when(~passed, "Model did not pass acceptance gate"))
            .withColumn("progress", F.lit(1.0)))


def model_stage(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike(RECOGNIZER_WORDS), "recognizer").when(n.rlike(DETECTOR_WORDS), "detector").otherwise("both")


def default_params(name: Column) -> Column:
    """Training parameters as JSON text."""
    n = F.lower(name)
    # fixed values: the parameters of each kind of model
    return (F.when(n.rlike("recognizer|crnn"), F.lit('{"epochs":20,"batch_size":64,"lr":0.0005}'))
            .when(n.rlike("detector|yolo"), F.lit('{"epochs":50,"batch_size":16,"imgsz":640}'))
            .otherwise(F.lit('{"epochs":20,"batch_size":32}')))


def deploy_gate(jobs: DataFrame, agents: DataFrame) -> DataFrame:
    """Deployment decision per job with the app to deploy to, or the reason to skip it."""
    passed = F.coalesce(F.get_json_object("result", "$.acceptance.gate_passed") == "true", F.lit(False))
    has_model = F.get_json_object("result", "$.model").isNotNull()
    reason = (F.when(F.col("status") != "completed", F.concat(F.lit("job status: "), "status"))
              .when(~passed, "quality_gate_failed").when(~has_model, "no_model_result"))
    agent = agents.select(F.col("id").alias("field_agent_id"), F.col("app_id").alias("_app"))
    return (jobs.join(agent, "field_agent_id", "left").withColumn("reason", reason)
            .withColumn("action", F.when(F.col("reason").isNull(), "deployed").otherwise("skipped"))
            .withColumn("target_app", F.when(F.col("reason").isNull(), F.col("_app"))).drop("_app"))
