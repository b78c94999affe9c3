"""Experiment results made from the events: user = run, event = epoch."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from ..operators import experiments
from ..plans.frames import r

# each metric as a function of the event; some epochs have no value
METRIC_SQL = {m: f"CASE WHEN event_id % {i + 3} = 1 THEN NULL ELSE round(value / {500 + 100 * i}, 9) END"
              for i, m in enumerate(experiments.METRICS)}


def epochs(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("epoch"),
        *[F.expr(e).alias(m) for m, e in METRIC_SQL.items()])


LAST = f"""lst AS (SELECT * FROM events e WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)),
lw AS (SELECT 'run' || user_id AS run_id, {", ".join(f'{e} AS "{m}"' for m, e in METRIC_SQL.items())} FROM lst),
ll AS (SELECT run_id, metric, value FROM lw UNPIVOT (value FOR metric IN ({", ".join(f'"{m}"' for m in METRIC_SQL)})))"""


@query("exp_last_epoch", f"WITH {LAST} SELECT run_id, metric, value FROM ll")
def exp_last_epoch(spark, sf):
    return experiments.last_epoch(epochs(spark, sf))


def runs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("dataset"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("version"),
        F.when(F.col("event_id") % 8 != 0, F.col("value")).alias("score"), F.col("ts").alias("created_at"))


RUNS = """rn AS (SELECT event_id AS run_id, event_type AS dataset, 'v' || (user_id % 3) AS version,
 CASE WHEN event_id % 8 <> 0 THEN value END AS score, ts AS created_at FROM events)"""


@query("exp_list", f"WITH {RUNS} SELECT run_id, version, created_at FROM rn WHERE dataset = 'click' ORDER BY created_at DESC, run_id")
def exp_list(spark, sf):
    return experiments.list_runs(runs(spark, sf), "click").select("run_id", "version", "created_at")


@query("exp_best", f"""WITH {RUNS} SELECT dataset, version, run_id, score FROM (SELECT *, row_number() OVER (PARTITION BY dataset, version
 ORDER BY score DESC, run_id) AS k FROM rn WHERE score IS NOT NULL) WHERE k = 1""")
def exp_best(spark, sf):
    return experiments.best(runs(spark, sf), "score")


@query("exp_compare", f"""WITH {LAST} SELECT metric, max(value) FILTER (run_id = 'run8') AS run8, max(value) FILTER (run_id = 'run3') AS run3,
 max(value) FILTER (run_id = 'run5') AS run5 FROM ll WHERE run_id IN ('run8', 'run3', 'run5') GROUP BY metric""")
def exp_compare(spark, sf):
    long = experiments.last_epoch(epochs(spark, sf))
    return experiments.compare(long, ["run8", "run3", "run5"])


@query("exp_version_number", f"""WITH {RUNS} SELECT run_id, dataset, version, 'exp_' || row_number() OVER (PARTITION BY dataset, version
 ORDER BY created_at, run_id) AS experiment FROM rn""")
def exp_version_number(spark, sf):
    return experiments.version_numbers(runs(spark, sf).drop("score")).select("run_id", "dataset", "version", "experiment")


@query("exp_table", """SELECT event_id AS run_id, round(value / 500, 6) AS "metric/mAP50", CASE WHEN event_id % 4 <> 0 THEN round(value / 700, 6) END AS "metric/recall",
 (user_id % 3)::VARCHAR AS "param/epochs", event_type AS "param/data" FROM events""")
def exp_table(spark, sf):
    metrics = F.to_json(F.struct((F.col("value") / 500).alias("mAP50"),
                                 F.when(F.col("event_id") % 4 != 0, F.col("value") / 700).alias("recall")))
    params = F.to_json(F.struct((F.col("user_id") % 3).cast("string").alias("epochs"), F.col("event_type").alias("data")))
    e = table(spark, sf, "events").select(F.col("event_id").alias("run_id"), metrics.alias("metrics"), params.alias("params"))
    t = experiments.table(e, ["epochs", "data"], ["mAP50", "recall"])
    return t.select("run_id", r(F.col("`metric/mAP50`")).alias("metric/mAP50"), r(F.col("`metric/recall`")).alias("metric/recall"),
                    F.col("`param/epochs`"), F.col("`param/data`"))
