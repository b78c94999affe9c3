"""Report envelopes: building, classifying, validating and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import general_text

# ---- outgoing: protocol 1.0 ------------------------------------------------


def drift_envelope(result: DataFrame, app_id: str) -> DataFrame:
    """Wrap drift results (snapshot_id, modality, model_name, overall_score, status) as report JSON."""
    overall = F.coalesce("overall_score", F.lit(0.0))
    severity = F.coalesce(F.col("status"), F.when(overall >= 0.25, "critical").when(overall >= 0.15, "warning")
                          .otherwise("normal"))
    body = F.struct(
        F.lit("1.0").alias("protocol_version"),
        F.struct(F.lit(app_id).alias("app_id"), F.lit("drift_analysis").alias("app_type")).alias("source"),
        F.struct("snapshot_id", "model_name", "modality", F.struct(overall.alias("overall")).alias("scores"),
                 severity.alias("severity")).alias("drift"))
    return result.select("snapshot_id", severity.alias("severity"), overall.alias("overall"),
                         F.to_json(body).alias("envelope"))


def classify(payload: Column) -> Column:
    """multi_modal, eda or drift, by the keys of the JSON object."""
    keys = F.json_object_keys(payload)

    def has(k: str) -> Column:
        return F.array_contains(keys, k)

    eda = (has("files_analyzed") | has("series_analyzed") | has("texts_analyzed")
           | (has("summary") & ~has("overall_score")))
    return F.when(has("modalities"), "multi_modal").when(eda, "eda").otherwise("drift")


# ---- incoming: protocol 1.1 ------------------------------------------------

# The columns of a decision table.
DECISION_COLUMNS = ["id", "created_at", "decision_type", "decision", "model_name", "model_version",
                    "threshold_applied", "scores_json", "inputs_ref_json", "result_summary", "trace_json",
                    "site_id", "ingested_at", "source_file"]

# top-level values stay JSON text, so that a wrong type is seen and not read as null
_TOP = T.StructType([T.StructField(n, T.StringType()) for n in (
    "protocol_version", "sent_at", "source", "payload_kinds", "decision_batch", "drift_report")])
_SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("app_id", "app_type", "instance_id")])
_DECISION = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "created_at", "decision_type", "decision", "model_name", "model_version", "threshold_applied",
    "scores", "inputs_ref", "result_summary", "trace")])


def _falsy(c: Column) -> Column:
    """Absent, or an empty JSON value."""
    return c.isNull() | F.trim(c).isin("", "null", "[]", "{}", "0", "false")


def validate(files: DataFrame) -> DataFrame:
    """(source_file, content) -> parsed envelope with ``reason`` null where it is accepted."""
    top = files.withColumn("_e", F.from_json("content", _TOP)).withColumn(
        "_is_object", F.coalesce(F.try_parse_json("content").isNotNull()
                                 & F.rtrim(F.ltrim("content")).startswith("{"), F.lit(False)))
    e = F.col("_e")
    kinds = F.from_json(e.payload_kinds, "array<string>")
    has_batch = F.coalesce(F.array_contains(F.col("kinds"), "decision_batch"), F.lit(False))
    has_drift = F.coalesce(F.array_contains(F.col("kinds"), "drift_report"), F.lit(False))
    parsed = (top.withColumn("_s", F.from_json(e.source, _SOURCE))
              .withColumn("kinds", F.when(F.ltrim(e.payload_kinds).startswith("["), kinds))
              .withColumn("batch_json", F.when(has_batch, e.decision_batch))
              .withColumn("drift_json", F.when(has_drift, e.drift_report))
              .withColumn("batch_items", F.from_json("batch_json", "array<string>"))
              .withColumn("batch", F.from_json("batch_json", T.ArrayType(_DECISION))))
    bad_item = F.exists("batch_items", lambda x: x.isNull() | ~F.ltrim(x).startswith("{"))
    malformed = F.exists("batch", lambda d: d.id.isNull() | d.decision_type.isNull() | d.decision.isNull())
    bad_threshold = F.exists("batch", lambda d: d.threshold_applied.isNotNull()
                             & d.threshold_applied.try_cast("double").isNull())
    reason = (F.when(~F.col("_is_object"), "invalid json")
              .when(~e.protocol_version.eqNullSafe("1.1"), "unsupported protocol_version")
              .when(_falsy(e.source) | ~F.ltrim(e.source).startswith("{") | _falsy(F.col("_s.app_id")),
                    "source.app_id is required")
              .when(~_falsy(e.payload_kinds) & ~F.ltrim(e.payload_kinds).startswith("["),
                    "payload_kinds must be a list")
              .when(~_falsy(F.col("batch_json")) & ~F.ltrim("batch_json").startswith("["),
                    "decision_batch must be a list")
              .when(bad_item, "decision is not an object")
              .when(malformed | bad_threshold, "decision malformed")
              .when(F.col("drift_json").isNotNull() & ~F.ltrim("drift_json").startswith("{"),
                    "drift_report must be an object"))
    return parsed.select(
        "source_file", reason.alias("reason"), F.col("_s.app_id").alias("app_id"),
        F.coalesce("_s.app_type", F.lit("video_forensics")).alias("app_type"),
        F.col("_s.instance_id").alias("instance_id"), "kinds", "batch", "drift_json")


def site_of(parsed: DataFrame, explicit: str | None = None) -> DataFrame:
    """One row ``site_id``: given, else app of the first accepted file by name, else "default"."""
    first = parsed.where("reason IS NULL").agg(F.min_by("app_id", "source_file").alias("a"))
    return first.select(F.coalesce(F.lit(explicit), F.col("a"), F.lit("default")).alias("site_id"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"d.{c}"), F.lit(""))


def _json_text(c: str) -> Column:
    return F.when(_falsy(F.col(f"d.{c}")), F.lit("")).otherwise(F.col(f"d.{c}"))


def decisions(parsed: DataFrame, site: DataFrame, ingested_at: Column) -> DataFrame:
    """One row per decision of the accepted files, in the fixed columns."""
    from ..plans.frames import with_scalars
    rows = parsed.where("reason IS NULL").select("source_file", F.explode("batch").alias("d"))
    out = rows.select(
        F.col("d.id").alias("id"), _text("created_at").alias("created_at"), F.col("d.decision_type").alias("decision_type"),
        F.col("d.decision").alias("decision"), _text("model_name").alias("model_name"),
        _text("model_version").alias("model_version"),
        F.coalesce(general_text(F.col("d.threshold_applied").try_cast("double")), F.lit(""))
        .alias("threshold_applied"),
        _json_text("scores").alias("scores_json"), _json_text("inputs_ref").alias("inputs_ref_json"),
        _text("result_summary").alias("result_summary"), _json_text("trace").alias("trace_json"),
        ingested_at.alias("ingested_at"), "source_file")
    return with_scalars(out, site).select(*DECISION_COLUMNS)


def drift_reports(parsed: DataFrame, site: DataFrame, ingested_at: Column) -> DataFrame:
    from ..plans.frames import with_scalars
    rows = parsed.where("reason IS NULL AND drift_json IS NOT NULL").select(
        "source_file", ingested_at.alias("ingested_at"), F.col("drift_json").alias("report"))
    return with_scalars(rows, site)


def run_manifest(parsed: DataFrame) -> DataFrame:
    ok = F.col("reason").isNull()
    return parsed.agg(
        F.count("*").alias("files_seen"), F.count_if(ok).alias("files_processed"),
        F.count_if(~ok).alias("files_skipped"),
        F.coalesce(F.sum(F.when(ok, F.size(F.coalesce("batch", F.array())))), F.lit(0)).alias("decision_rows"),
        F.count_if(ok & F.col("drift_json").isNotNull()).alias("drift_reports"))
