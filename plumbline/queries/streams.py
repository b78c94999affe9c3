"""The streams, fed with the events in four steps of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from .decisions import MANIFEST_SQL, REPORTS, event_envelopes, reports
from ..plans.frames import r
from ..plans.scratch import scratch_path
from ..sources.envelopes import read_envelope_stream
from ..streaming import jobs, silence

STEPS = ["2024-01-08", "2024-01-16", "2024-01-24"]


def stepwise(df, ts, path, take_in):
    """Write the rows step by step and let the stream take in each step before the next."""
    schema = df.schema
    bounds = [None, *STEPS, None]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi == STEPS[0] and df.where(F.col(ts) < F.to_timestamp(F.lit(hi))).isEmpty():
            continue
        part = df
        if lo:
            part = part.where(F.col(ts) >= F.to_timestamp(F.lit(lo)))
        if hi:
            part = part.where(F.col(ts) < F.to_timestamp(F.lit(hi)))
        part.write.mode("append").parquet(path)
        take_in(df.sparkSession.readStream.schema(schema).parquet(path))


def report_rows(spark, sf):
    return reports(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("stream_ingest", f"""SELECT 1 AS run, * FROM ({MANIFEST_SQL}) UNION ALL SELECT 2, * FROM ({MANIFEST_SQL})""")
def stream_ingest(spark, sf):
    path = scratch_path(spark, "ingest")
    event_envelopes(spark, sf).select("content").write.text(f"{path}/in")
    out = None
    for run in (1, 2):  # the second run finds nothing new
        stream = read_envelope_stream(spark, f"{path}/in", "keep", one_per_file=False)
        jobs.ingest_stream(stream, f"{path}/out", f"{path}/checkpoint")
        names = ["files_seen", "files_processed", "files_skipped", "decision_rows", "drift_reports"]
        got = spark.read.parquet(f"{path}/out/manifest").agg(*[F.sum(n).alias(n) for n in names]).first()
        one = spark.range(1).select(F.lit(run).alias("run"), *[F.lit(got[n]).cast("bigint").alias(n) for n in names])
        out = one if out is None else out.unionByName(one)
    return out


@query("stream_escalation", f"""WITH {REPORTS}, cnt AS (SELECT id, agent_id, model_name, count(*) OVER (PARTITION BY agent_id, model_name
 ORDER BY created_at RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND CURRENT ROW) AS n_recent FROM rep WHERE severity = 'medium')
SELECT id, agent_id, model_name, n_recent, n_recent >= 3 AS escalate FROM cnt""")
def stream_escalation(spark, sf):
    path = scratch_path(spark, "escalation")
    stepwise(report_rows(spark, sf), "created_at", f"{path}/in",
             lambda stream: jobs.escalation_stream(stream, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out/decisions").select("id", "agent_id", "model_name", "n_recent", "escalate")


@query("stream_report_counts", f"""WITH {REPORTS}, top AS (SELECT max(created_at) AS top FROM rep),
h AS (SELECT * FROM (SELECT date_trunc('hour', created_at) AS start, model_name, severity, count(*) AS n FROM rep GROUP BY ALL)
 WHERE start + INTERVAL 2 HOURS <= (SELECT top FROM top)),
s AS (SELECT agent_id, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM rep
 WINDOW w AS (PARTITION BY agent_id ORDER BY created_at)),
g AS (SELECT agent_id, created_at, sum(new) OVER (PARTITION BY agent_id ORDER BY created_at) AS k FROM s)
SELECT 'hour' AS kind, start, model_name AS name, severity, n FROM h
UNION ALL SELECT 'two days', start - INTERVAL 1 HOUR * k, model_name, severity, CAST(sum(n) AS BIGINT) FROM h CROSS JOIN (SELECT unnest(range(48)) AS k) GROUP BY ALL
UNION ALL SELECT 'session', min(created_at), 'agent ' || agent_id, '', count(*) FROM g GROUP BY agent_id, k
 HAVING max(created_at) + INTERVAL 7 HOURS <= (SELECT top FROM top)""")
def stream_report_counts(spark, sf):
    path = scratch_path(spark, "counts")

    def take_in(stream):
        jobs.table_stream(jobs.hourly_counts(stream), f"{path}/hourly", f"{path}/c1", also={"sliding": jobs.sliding_counts})
        jobs.table_stream(jobs.agent_sessions(stream), f"{path}/sessions", f"{path}/c2")

    stepwise(report_rows(spark, sf), "created_at", f"{path}/in", take_in)
    # an hour, two-day window or session counts once the watermark has closed it
    hour = spark.read.parquet(f"{path}/hourly/rows").select(F.lit("hour").alias("kind"), "start", F.col("model_name").alias("name"), "severity", "n")
    two = (spark.read.parquet(f"{path}/hourly/sliding").groupBy("start", "model_name", "severity").agg(F.sum("n").alias("n"))
           .select(F.lit("two days").alias("kind"), "start", F.col("model_name").alias("name"), "severity", "n"))
    ses = spark.read.parquet(f"{path}/sessions/rows").select(
        F.lit("session").alias("kind"), "start", F.concat(F.lit("agent "), F.col("agent_id").cast("string")).alias("name"),
        F.lit("").alias("severity"), "n")
    out = hour.unionByName(two).unionByName(ses)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_MONITOR = """ev AS (SELECT ts, value, (user_id % 10)::DOUBLE AS user_digit FROM events),
lng AS (SELECT ts, attr, value FROM (SELECT ts, value AS v, user_digit FROM ev) UNPIVOT (value FOR attr IN (v, user_digit))),
rg AS (SELECT attr, min(value) AS lo, max(value) AS hi, count(*) AS nb FROM lng WHERE ts < TIMESTAMP '2024-01-08' GROUP BY attr),
bn AS (SELECT attr, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN -1 WHEN ts < TIMESTAMP '2024-01-16' THEN 0 WHEN ts < TIMESTAMP '2024-01-24' THEN 1 ELSE 2 END AS batch,
 least(floor((greatest(least(value, hi), lo) - lo) / (hi - lo) * 10), 9) AS bin FROM lng JOIN rg USING (attr)),
ct AS (SELECT attr, batch, bin, count(*) AS n FROM bn GROUP BY ALL),
tt AS (SELECT attr, batch, sum(n) AS t FROM ct GROUP BY ALL),
gd AS (SELECT tt.attr, tt.batch, t, b AS bin FROM tt CROSS JOIN (SELECT unnest(range(10)) AS b) WHERE batch >= 0),
sc AS (SELECT gd.attr, gd.batch, any_value(gd.t) AS n_rows, abs(sum((((coalesce(c.n, 0) + 1) / (gd.t + 10)) - ((coalesce(k.n, 0) + 1) / (rg.nb + 10)))
  * ln(((coalesce(c.n, 0) + 1) / (gd.t + 10)) / ((coalesce(k.n, 0) + 1) / (rg.nb + 10))))) AS score
 FROM gd JOIN rg USING (attr) LEFT JOIN ct c ON c.attr = gd.attr AND c.batch = gd.batch AND c.bin = gd.bin
 LEFT JOIN ct k ON k.attr = gd.attr AND k.batch = -1 AND k.bin = gd.bin GROUP BY gd.attr, gd.batch)"""


@query("stream_drift_monitor", f"""WITH {_MONITOR} SELECT CAST(batch AS INTEGER) AS batch, CAST(any_value(n_rows) AS BIGINT) AS n_rows, round(avg(score), 6) AS overall_score,
 CASE WHEN avg(score) < 0.15 THEN 'NORMAL' WHEN avg(score) < 0.25 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM sc GROUP BY batch""")
def stream_drift_monitor(spark, sf):
    path = scratch_path(spark, "monitor")
    e = table(spark, sf, "events").select("event_id", "ts", "value", (F.col("user_id") % 10).cast("double").alias("user_digit"))
    late = e.where(F.col("ts") >= F.to_timestamp(F.lit(STEPS[0])))
    base = e.where(F.col("ts") < F.to_timestamp(F.lit(STEPS[0])))
    stepwise(late, "ts", f"{path}/in", lambda stream: jobs.drift_monitor(
        stream, base, ["value", "user_digit"], f"{path}/out", f"{path}/checkpoint"))
    t = spark.read.parquet(f"{path}/out/timeline")
    return t.select("batch", "n_rows", r("overall_score").alias("overall_score"), "status").orderBy("batch")


_SILENT = """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 24 HOURS THEN 0 ELSE 1 END AS new FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id AS agent_id, max(ts) AS last_seen, count(*) AS n_messages FROM g GROUP BY user_id, k
HAVING max(ts) + INTERVAL 25 HOURS <= (SELECT max(ts) FROM events)"""


@query("stream_heartbeat", _SILENT)
def stream_heartbeat(spark, sf):
    path = scratch_path(spark, "heartbeat")
    stepwise(report_rows(spark, sf).select("agent_id", "created_at"), "created_at", f"{path}/in",
             lambda stream: jobs.heartbeat_stream(stream, f"{path}/out", f"{path}/checkpoint", "24 hours"))
    alarms = spark.read.parquet(f"{path}/out/rows")
    return alarms.select("agent_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n_messages")


@query("stream_heartbeat_timer", _SILENT)
def stream_heartbeat_timer(spark, sf):
    """Each agent's own timer, with the watermark as its clock."""
    path = scratch_path(spark, "silence")
    stepwise(report_rows(spark, sf).select("agent_id", "created_at"), "created_at", f"{path}/in",
             lambda stream: silence.silence_stream(stream, f"{path}/out", f"{path}/checkpoint", "24 hours", "1 hour"))
    told = jobs.read_batches(spark, f"{path}/out/rows", "agent_id bigint, kind string, last_seen timestamp, n_messages bigint")
    return told.where("kind = 'silent'").select("agent_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n_messages")
