"""Table versions: fingerprints, state, names, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.frames import micros
from ..plans.ordered import numbered


class VersionState(ValueError):
    """A dataset is not in the state the policy asks for."""


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """One row: content hash of a table that does not depend on the order of rows."""
    h = F.xxhash64(*df.columns)
    parts = df.select(h.alias("h")).agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).alias("total"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mix"))
    text = F.concat_ws(":", F.col("n_rows").cast("string"), F.col("total").cast("string"), F.col("mix").cast("string"),
                       F.lit(",".join(f"{n} {t}" for n, t in df.dtypes)))
    return parts.select(F.lit(name).alias("name"), "n_rows", F.md5(text).alias("hash"))


def status(current: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, hash) against the latest registered version: clean, modified or unversioned."""
    latest = registry.groupBy("name").agg(F.max_by(F.struct("version", "hash", "alias"), "created_at").alias("l"))
    return current.join(latest, "name", "left").select(
        "name", "hash", F.col("l.version").alias("version"), F.col("l.alias").alias("alias"),
        F.when(F.col("l").isNull(), "unversioned").when(F.col("l.hash") == F.col("hash"), "clean")
        .otherwise("modified").alias("state"))


def check(states: DataFrame, policy: str) -> DataFrame:
    """What the policy does about each state; ``strict`` raises if any table is not clean."""
    if policy not in ("strict", "warning", "auto"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "strict":
        bad = states.where(F.col("state") != "clean").select("name", "state").first()
        if bad is not None:
            raise VersionState(f"{bad['name']} is {bad['state']}")
    outcome = {"strict": "error", "warning": "warning", "auto": "new version"}[policy]
    return states.withColumn("outcome", F.when(F.col("state") == "clean", "ok").otherwise(outcome))


def next_version(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Next minor version per name; v1.0 without any, other version names do not count."""
    number = F.regexp_extract("version", r"^v(\d+)\.(\d+)$", 0) != ""
    pair = F.struct(F.regexp_extract("version", r"^v(\d+)\.(\d+)$", 1).try_cast("bigint").alias("major"),
                    F.regexp_extract("version", r"^v(\d+)\.(\d+)$", 2).try_cast("bigint").alias("minor"))
    top = registry.groupBy("name").agg(F.max(F.when(number, pair)).alias("m"), F.count("*").alias("n"))
    nxt = F.concat(F.lit("v"), F.coalesce("m.major", F.lit(0)).cast("string"), F.lit("."),
                   (F.coalesce("m.minor", F.lit(0)) + 1).cast("string"))
    return names.join(top, "name", "left").select(
        "name", F.when(F.col("n").isNull(), "v1.0").otherwise(nxt).alias("next_version"))


def resolve_alias(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, alias) -> version; null if the alias is unknown or names several versions."""
    known = aliases.groupBy("name", "alias").agg(F.count_distinct("version").alias("n"), F.min("version").alias("v"))
    return wanted.join(known, ["name", "alias"], "left").select(
        "name", "alias", F.when(F.col("n") == 1, F.col("v")).alias("version"),
        F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "conflict").otherwise("ok").alias("state"))


def newest_first(df: DataFrame, keys: Sequence[str], ts: str, row_id: str) -> DataFrame:
    """Rows with ``rank`` 1 for the newest of each key, also for keys with very many rows."""
    neg = df.withColumn("_neg", -micros(df, ts))
    return numbered(neg, keys, ["_neg", row_id], "rank").withColumn("rank", F.col("rank") + 1).drop("_neg", "rank_total")


def snapshots_newest(snapshots: DataFrame, aliases: DataFrame, limit: int = 50) -> DataFrame:
    return snapshots.join(aliases, "id", "left").orderBy(F.desc("created_at"), "id").limit(limit)
