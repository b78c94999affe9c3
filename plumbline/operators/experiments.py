"""Results of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.ordered import numbered

# Names of the epoch metrics.
METRICS = ["mAP50", "mAP50-95", "precision", "recall", "box_loss", "cls_loss", "dfl_loss",
           "val_box_loss", "val_cls_loss", "val_dfl_loss"]


def last_epoch(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """(run, metric, value) of the last epoch, nulls left out."""
    present = [m for m in METRICS if m in epochs.columns]
    last = epochs.groupBy(run).agg(F.max_by(F.struct(*[F.col(f"`{m}`") for m in present]), epoch).alias("m"))
    wide = last.select(run, *[F.col(f"m.`{m}`").cast("double").alias(m) for m in present])
    return wide.unpivot([run], [F.col(f"`{m}`") for m in present], "metric", "value").where("value IS NOT NULL")


def list_runs(runs: DataFrame, dataset: str | None = None) -> DataFrame:
    if dataset is not None:
        runs = runs.where(F.col("dataset") == dataset)
    return runs.orderBy(F.desc("created_at"), "run_id")


def best(runs: DataFrame, metric: str) -> DataFrame:
    """Best run per dataset version by a metric; runs without it do not count."""
    return runs.where(F.col(metric).isNotNull()).groupBy("dataset", "version").agg(
        F.min_by("run_id", F.struct(-F.col(metric), F.col("run_id"))).alias("run_id"), F.max(metric).alias(metric))


def compare(long: DataFrame, run_ids: Sequence[str], run: str = "run_id") -> DataFrame:
    """The chosen runs side by side per metric; fewer than two found is an error."""
    chosen = long.where(F.col(run).isin(list(run_ids)))
    found = [r[0] for r in chosen.select(run).distinct().collect()]
    if len(found) < 2:
        raise ValueError(f"need two runs to compare, found {len(found)}")
    return chosen.groupBy("metric").pivot(run, [r for r in run_ids if r in found]).agg(F.first("value"))


def version_numbers(runs: DataFrame) -> DataFrame:
    """Running ``exp_<n>`` per dataset version in time order."""
    n = numbered(runs, ["dataset", "version"], ["created_at", "run_id"], "_n")
    return n.withColumn("experiment", F.concat(F.lit("exp_"), (F.col("_n") + 1).cast("string"))).drop("_n", "_n_total")


def table(runs: DataFrame, params: Sequence[str] | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
    """(run_id, params, metrics) JSON objects as columns param/* and metric/*, best mAP50 first.

    The names are looked up in the data where they are not given.
    """
    def flat(column: str, prefix: str) -> DataFrame:
        return runs.select("run_id", F.explode(F.from_json(column, "map<string,string>"))).select(
            "run_id", F.concat(F.lit(prefix), "key").alias("name"), "value")

    both = flat("metrics", "metric/").unionByName(flat("params", "param/"))
    names = None
    if params is not None and metrics is not None:
        names = [f"metric/{m}" for m in metrics] + [f"param/{p}" for p in params]
    grouped = both.groupBy("run_id")
    wide = (grouped.pivot("name", names) if names else grouped.pivot("name")).agg(F.first("value"))
    for c in wide.columns:
        if c.startswith("metric/"):
            wide = wide.withColumn(c, F.col(f"`{c}`").try_cast("double"))
    if "metric/mAP50" in wide.columns:
        wide = wide.orderBy(F.desc("`metric/mAP50`"), "run_id")
    return wide
