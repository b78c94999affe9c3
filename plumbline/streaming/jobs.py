"""Streams of envelopes, reports and measurements.

Every batch writes under its own number and overwrites it, so a batch that is run
again after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalar import status_label
from ..operators import decisions as D
from ..operators import drift, envelopes as E
from ..plans.binning import bin_index, histogram
from ..plans.frames import micros, one_row, to_long, with_scalars


#: Sessions are merged before the shuffle, so that a busy key does not send all its rows to one task.
MERGE_SESSIONS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def run_available(writer, checkpoint: str, once: bool = True, every: str | None = None, spark: SparkSession | None = None,
                  settings: dict[str, str] | None = None):
    """Start a stream; ``once`` takes what is there and stops, else it goes on, with batches ``every`` so often.

    A stream keeps the settings of the session it starts in; ``settings`` hold for this start only.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    before = {k: spark.conf.get(k, None) for k in settings} if settings else {}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        query = writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if once:
        query.awaitTermination()
    return query


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


_write = write_batch


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches; none if no batch has written yet."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _before(spark, path: str, batch_id: int) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("batch") < batch_id)


def _remove_below(spark, path: str, name: str, least: int) -> None:
    """Delete the folders ``name=<number>`` below a number; there are few, since this runs in each batch."""
    if not _exists(spark, path):
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(where):
        key, _, value = status.getPath().getName().partition("=")
        if key == name and value.lstrip("-").isdigit() and int(value) < least:
            fs.delete(status.getPath(), True)


# ---- envelopes -------------------------------------------------------------

def ingest_stream(files: DataFrame, path: str, checkpoint: str, site: str | None = None, once: bool = True):
    """(source_file, content) -> decisions, drift reports, rejects and a manifest line per batch.

    The checkpoint remembers the files, so running it again takes in nothing twice.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        parsed = E.validate(batch).persist()
        where = E.site_of(parsed, site)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        _write(E.decisions(parsed, where, now), f"{path}/decisions", batch_id)
        _write(E.drift_reports(parsed, where, now), f"{path}/drift_reports", batch_id)
        _write(parsed.where("reason IS NOT NULL").select("source_file", "reason"), f"{path}/rejected", batch_id)
        _write(one_row(E.run_manifest(parsed), where), f"{path}/manifest", batch_id)
        parsed.unpersist()

    return run_available(files.writeStream.foreachBatch(each), checkpoint, once)


# ---- escalation ------------------------------------------------------------

def escalation_stream(reports: DataFrame, path: str, checkpoint: str, delay_hours: float = 1.0, once: bool = True):
    """(id, agent_id, model_name, severity, created_at) -> trailing count and escalation per medium report.

    A report later than the newest one of earlier batches by more than the delay is
    dropped and counted. The reports of the last 48 hours are kept as a table by day,
    and each batch counts over them by range chunks: state kept by key would put a busy
    agent in one task. Days that no later batch can ask for are removed, and so is the
    progress of all batches but the last two; it holds running totals.
    """
    delay, hour = int(delay_hours * 3_600_000_000), 3_600_000_000

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        medium = batch.where("severity = 'medium'").withColumn("at", micros(batch, "created_at")).persist()
        last = f"{path}/progress/batch={batch_id - 1}"
        seen = spark.read.parquet(last).first() if _exists(spark, last) else None
        newest, dropped, taken = (seen["newest"], seen["dropped"], seen["taken"]) if seen else (None, 0, 0)
        on_time = medium if newest is None else medium.where(F.col("at") >= newest - delay)
        bounds = on_time.agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n")).first()
        dropped, taken = dropped + medium.count() - bounds["n"], taken + bounds["n"]
        top = max(x for x in (newest, bounds["hi"], 0) if x is not None)
        if bounds["n"]:
            history = _before(spark, f"{path}/recent", batch_id)
            fresh = on_time.withColumn("_new", F.lit(True))
            if history is None:
                known = fresh
            else:
                start = bounds["lo"] - int(D.ESCALATION_HOURS) * hour
                # whole days are skipped by the folder name, the rest by the time
                old = history.where((F.col("day") >= start // (24 * hour)) & (F.col("at") >= start)).drop("day", "batch")
                known = fresh.unionByName(old.withColumn("_new", F.lit(False)))
            counted = D.trailing_counts(known, ["agent_id", "model_name"], "created_at", "id", D.ESCALATION_HOURS)
            mine = on_time.select("id", "agent_id", "model_name", "created_at").join(counted, "id").select(
                "id", "agent_id", "model_name", "created_at", F.col("n").alias("n_recent"),
                (F.col("n") >= D.ESCALATION_COUNT).alias("escalate"))
            _write(mine, f"{path}/decisions", batch_id)
            (on_time.withColumn("day", F.floor(F.col("at") / (24 * hour))).withColumn("batch", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("day", "batch").parquet(f"{path}/recent"))
        _write(spark.range(1).select(F.lit(top).cast("bigint").alias("newest"), F.lit(dropped).cast("bigint").alias("dropped"),
                                     F.lit(taken).cast("bigint").alias("taken")), f"{path}/progress", batch_id)
        _remove_below(spark, f"{path}/progress", "batch", batch_id - 1)
        if newest is not None:
            # a repeated batch asks for the same days, so what goes depends on the batches before
            _remove_below(spark, f"{path}/recent", "day", (newest - delay - int(D.ESCALATION_HOURS) * hour) // (24 * hour))
        medium.unpersist()

    return run_available(reports.writeStream.foreachBatch(each), checkpoint, once)


# ---- counts ----------------------------------------------------------------

def hourly_counts(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Reports per model and severity in tumbling hours."""
    return (reports.withWatermark("created_at", delay)
            .groupBy(F.window("created_at", "1 hour").alias("w"), "model_name", "severity").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), "model_name", "severity", "n"))


def sliding_counts(hourly: DataFrame, hours: int = 48) -> DataFrame:
    """48-hour windows every hour, added up from the hourly counts instead of from the reports.

    Of a part of the hours it gives that part of the sums, so the parts of all batches add up.
    """
    starts = F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda k: F.timestamp_add("HOUR", -k, F.col("start")))
    return (hourly.withColumn("start", F.explode(starts)).groupBy("start", "model_name", "severity")
            .agg(F.sum("n").alias("n")))


def agent_sessions(reports: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions of each agent, ended by a gap without reports. To be started with ``MERGE_SESSIONS``, as ``table_stream`` does."""
    return (reports.withWatermark("created_at", delay)
            .groupBy("agent_id", F.session_window("created_at", gap).alias("w"))
            .agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))
            .select("agent_id", F.col("w.start").alias("start"), "last_seen", "n"))


def table_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True,
                 also: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
    """Write the rows that the watermark has closed, batch by batch; their state is gone then."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        _write(batch, f"{path}/rows", batch_id)
        for name, derive in (also or {}).items():
            _write(derive(batch), f"{path}/{name}", batch_id)
        batch.unpersist()

    return run_available(df.writeStream.outputMode("append").foreachBatch(each), checkpoint, once, None, df.sparkSession, MERGE_SESSIONS)


def heartbeat_stream(messages: DataFrame, path: str, checkpoint: str, silent: str = "24 hours", delay: str = "1 hour",
                     once: bool = True):
    """(agent_id, created_at) -> a row whenever an agent has been silent for the given time.

    The end of a session by that gap is the alarm; the watermark is the clock.
    """
    alarms = agent_sessions(messages, silent, delay).select("agent_id", "last_seen", F.col("n").alias("n_messages"))
    return table_stream(alarms, path, checkpoint, once)


# ---- drift of arriving rows ------------------------------------------------

def baseline_bins(base: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(attr, bin, lo, hi, n_base, n_base_total) of the fixed baseline, all bins."""
    return histogram(to_long(base, columns, ids=()), bins).withColumnsRenamed({"n": "n_base", "n_total": "n_base_total"})


def batch_psi(baseline: DataFrame, batch: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(attr, score) against the baseline bins; values outside its range count in the end bins."""
    ranges = baseline.groupBy("attr").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    clamped: Column = F.greatest(F.least(F.col("value"), F.col("hi")), F.col("lo"))
    counts = (to_long(batch, columns, ids=()).join(F.broadcast(ranges), "attr")
              .groupBy("attr", bin_index(clamped, F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n_target")))
    # a window holds the bins of one attribute
    hist = baseline.join(counts, ["attr", "bin"], "left").fillna(0, ["n_target"]).withColumn(
        "n_target_total", F.sum("n_target").over(Window.partitionBy("attr")))
    return drift.psi_of_counts(hist, bins)


def drift_monitor(rows: DataFrame, base: DataFrame, columns: Sequence[str], path: str, checkpoint: str,
                  bins: int = 10, once: bool = True):
    """Score every batch against the fixed baseline and add it to the timeline."""
    if not _exists(rows.sparkSession, f"{path}/baseline/_SUCCESS"):
        baseline_bins(base, columns, bins).write.mode("overwrite").parquet(f"{path}/baseline")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        scores = batch_psi(spark.read.parquet(f"{path}/baseline"), batch, columns, bins)
        size = batch.agg(F.count("*").alias("n_rows"))
        overall = scores.agg(F.avg("score").alias("overall_score"))
        line = with_scalars(one_row(overall, size), spark.range(1).select(F.current_timestamp().alias("timestamp")))
        _write(line.withColumn("status", status_label(F.col("overall_score"))), f"{path}/timeline", batch_id)
        _write(scores, f"{path}/scores", batch_id)
        batch.unpersist()

    return run_available(rows.writeStream.foreachBatch(each), checkpoint, once)
