"""Snapshots of a keyed table: buckets of rows under a tree of digests.

A snapshot's rows lie in buckets by the hash of their key. Each bucket has a digest of its
rows that does not depend on their order; ``FAN`` neighbouring buckets have a digest of
theirs, and so on up to the root, which is the digest of the table. The tree is stored
with the snapshot and names the folder that holds each bucket's rows, so

- a snapshot made from another one writes only the buckets that it changes and shares the
  folders of all others (``upsert``),
- two snapshots are compared from the root down, and only buckets that differ are read
  (``changed_buckets``, ``diff``),
- all snapshots are verified in one job that reads a shared bucket once (``verify``).

A store has one key, one schema and one number of buckets. Keys are unique and not null,
anything else is refused: with unique keys the hash deals the rows evenly. A bucket's digest
is its row count and two sums of 64-bit hashes of whole rows, nulls included; maps and
columns called ``bucket`` or ``written_by`` are not taken. The driver sees one entry per
bucket, never rows. A snapshot exists once its tree is written: rows of a commit that
failed lie in a folder that no tree names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import compare
from ..plans.scratch import cut, discard, exists, written

#: Children of a node; the number of buckets is a power of it.
FAN = 8
#: 8 to the power of 5; at 100 TB a bucket has 3 GB.
MOST_BUCKETS = 32_768

TREE = ("version string, level int, node int, digest string, n_rows bigint, written_by string, about string")


class Store(NamedTuple):
    """What all snapshots of a store share."""
    key: str
    buckets: int
    schema: StructType

    @property
    def depth(self) -> int:
        return (self.buckets.bit_length() - 1) // (FAN.bit_length() - 1)


def _about(store: Store) -> str:
    return json.dumps({"key": store.key, "buckets": store.buckets, "schema": store.schema.jsonValue()}, sort_keys=True)


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _leaves(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(bucket, written_by, digest, n_rows) of rows with a bucket."""
    cells = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]   # hashes skip nulls
    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)")).cast("string")
    n = F.count("*")
    return rows.groupBy("bucket", "written_by").agg(F.md5(F.concat_ws(":", n.cast("string"), total(1), total(2))).alias("digest"),
                                                    n.alias("n_rows"))


def _tree(leaves: DataFrame, depth: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., level, node, digest, n_rows, written_by): the leaves and the nodes above them."""
    level = leaves.select(*by, F.lit(0).alias("level"), F.col("bucket").alias("node"), "digest", "n_rows", "written_by")
    levels = [level]
    named = F.array_sort(F.collect_list(F.concat_ws(":", "node", "digest")))   # at most FAN of them
    for i in range(1, depth + 1):
        up = level.withColumn("up", F.floor(F.col("node") / FAN).cast("int"))
        # the root is there for an empty table too
        groups = up.groupBy(*by, "up") if i < depth or by else up.groupBy()
        node = F.col("up") if i < depth or by else F.lit(0)
        level = groups.agg(F.md5(F.concat_ws(",", named)).alias("digest"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select(
            *by, F.lit(i).alias("level"), node.alias("node"), "digest", "n_rows", F.lit(None).cast("string").alias("written_by"))
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def trees(spark: SparkSession, store: str) -> DataFrame:
    """The trees of all snapshots, one row per node."""
    return spark.read.schema(TREE).parquet(f"{store}/trees")


def describe(spark: SparkSession, store: str) -> Store:
    about = trees(spark, store).where(F.col("about").isNotNull()).select("about").first()["about"]
    known = json.loads(about)
    return Store(known["key"], known["buckets"], StructType.fromJson(known["schema"]))


def _tree_of(spark: SparkSession, store: str, version: str, depth: int) -> DataFrame:
    out = trees(spark, store).where(F.col("version") == version)
    if out.where(F.col("level") == depth).isEmpty():
        raise ValueError(f"unknown snapshot {version!r}")
    return out


def _unique(rows: DataFrame, key: str) -> None:
    bad = rows.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).first()
    if bad is not None:
        raise ValueError(f"key {bad[key]!r} occurs {bad['count']} times")


def _read(spark: SparkSession, store: str, about: Store, leaves: Sequence[tuple[int, str]]) -> DataFrame:
    """Rows of the (bucket, written_by) pairs; no other folder is listed or read."""
    schema = StructType.fromJson(about.schema.jsonValue()).add("written_by", "string").add("bucket", "integer")
    if not leaves:
        return spark.createDataFrame([], schema)
    paths = [f"{store}/data/written_by={by}/bucket={bucket}" for bucket, by in leaves]
    return spark.read.schema(schema).option("basePath", f"{store}/data").parquet(*paths)


def _write(rows: DataFrame, store: str, about: Store) -> tuple[DataFrame, str]:
    """Write rows with a bucket into a folder of their own; its leaves and its name."""
    spark, name = rows.sparkSession, f"c{uuid.uuid4().hex}"
    path = f"{store}/data/written_by={name}"
    parts = min(about.buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.select(*about.schema.names, "bucket").repartition(parts, "bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(path)
    schema = StructType.fromJson(about.schema.jsonValue()).add("bucket", "integer")
    back = spark.read.schema(schema).parquet(path).withColumn("written_by", F.lit(name))
    return cut(_leaves(back, about.schema.names)), name


def _commit(leaves: DataFrame, store: str, version: str, about: Store) -> None:
    root = F.col("level") == about.depth
    tree = _tree(leaves, about.depth).select(F.lit(version).alias("version"), "*", F.when(root, F.lit(_about(about))).alias("about"))
    # one file per level at most: a tree has an eighth more nodes than buckets
    tree.coalesce(1).write.mode("append").parquet(f"{store}/trees")


def _new_version(spark: SparkSession, store: str, version: str) -> None:
    if not trees(spark, store).where(F.col("version") == version).isEmpty():
        raise ValueError(f"snapshot {version!r} exists")


def commit(rows: DataFrame, key: str, store: str, version: str, buckets: int = 4096) -> None:
    """Write a whole table as a snapshot of the store, which is made if it is not there."""
    spark = rows.sparkSession
    if buckets not in [FAN ** i for i in range(1, 6)] or buckets > MOST_BUCKETS:
        raise ValueError(f"buckets must be a power of {FAN} up to {MOST_BUCKETS}")
    if {"bucket", "written_by"} & set(rows.columns):
        raise ValueError("columns bucket and written_by belong to the store")
    plain = StructType.fromJson(rows.schema.jsonValue())
    for field in plain.fields:
        field.nullable = True
    about = Store(key, buckets, plain)
    if exists(spark, f"{store}/trees"):
        if _about(describe(spark, store)) != _about(about):
            raise ValueError("the store has another key, schema or number of buckets")
        _new_version(spark, store, version)
    kept = written(rows, "snapshot")
    _unique(kept, key)
    leaves, _ = _write(kept.withColumn("bucket", _bucket(key, buckets)), store, about)
    discard(kept)
    _commit(leaves, store, version, about)


def read(spark: SparkSession, store: str, version: str) -> DataFrame:
    """The rows of a snapshot."""
    about = describe(spark, store)
    leaves = _tree_of(spark, store, version, about.depth).where("level = 0").select("node", "written_by").collect()
    return _read(spark, store, about, leaves).select(*about.schema.names)


def upsert(spark: SparkSession, store: str, parent: str, version: str, changes: DataFrame, deleted: DataFrame | None = None) -> None:
    """A snapshot from ``parent`` with new or replaced rows, and without the ``deleted`` keys.

    Only buckets of keys that change are read and written; the other buckets stay in the
    folders where they are. A key that is both changed and deleted is there afterwards.
    """
    about = describe(spark, store)
    _new_version(spark, store, version)
    key, bucket = about.key, _bucket(about.key, about.buckets)
    new = written(changes.select(*about.schema.names).withColumn("bucket", bucket), "changes")
    _unique(new, key)
    gone = new.select(key, "bucket")
    if deleted is not None:
        gone = gone.unionByName(deleted.select(F.col(key).cast(about.schema[key].dataType)).withColumn("bucket", bucket))
    keys = written(gone.distinct(), "keys")
    before = _tree_of(spark, store, parent, about.depth).where("level = 0").select(
        F.col("node").alias("bucket"), "written_by", "digest", "n_rows")
    touched = keys.select("bucket").distinct()
    inside = before.join(touched, "bucket", "left_semi").select("bucket", "written_by").collect()
    old = _read(spark, store, about, inside)
    rows = old.join(keys.select(key), key, "left_anti").select(*about.schema.names, "bucket").unionByName(new)
    leaves, _ = _write(rows, store, about)
    outside = before.join(touched, "bucket", "left_anti")
    _commit(cut(outside.select(*leaves.columns).unionByName(leaves)), store, version, about)
    discard(new, keys)


def changed_buckets(spark: SparkSession, store: str, old: str, new: str) -> DataFrame:
    """(bucket, old_by, new_by): buckets that differ, found from the root down.

    Each level looks only at children of nodes that differ. A side without rows is null.
    """
    about = describe(spark, store)
    a, b = (_tree_of(spark, store, v, about.depth) for v in (old, new))
    above = None
    for level in range(about.depth, -1, -1):
        def side(t: DataFrame, name: str) -> DataFrame:
            out = t.where(F.col("level") == level).select("node", F.col("digest").alias(f"{name}_digest"), F.col("written_by").alias(f"{name}_by"))
            if above is None:
                return out
            return out.join(above, F.floor(F.col("node") / FAN).cast("int") == F.col("up"), "left_semi")
        both = side(a, "old").join(side(b, "new"), "node", "full_outer")
        differ = both.where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
        above = differ.select(F.col("node").alias("up"))
    return differ.select(F.col("node").alias("bucket"), "old_by", "new_by")


def diff(spark: SparkSession, store: str, old: str, new: str) -> DataFrame:
    """(key, state): added, removed and changed rows; rows that are the same are left out."""
    about = describe(spark, store)
    leaves = changed_buckets(spark, store, old, new).collect()
    before = _read(spark, store, about, [(x["bucket"], x["old_by"]) for x in leaves if x["old_by"]])
    after = _read(spark, store, about, [(x["bucket"], x["new_by"]) for x in leaves if x["new_by"]])
    names = about.schema.names
    return compare.row_diff(before.select(*names), after.select(*names), about.key).where(F.col("state") != "same")


def verify(spark: SparkSession, store: str) -> DataFrame:
    """Per snapshot: version, n_rows, n_buckets, n_changed, n_missing, tree_ok, valid.

    Digests are made again from the rows that can be read, a bucket that several snapshots
    share once. A bucket is changed if its rows give another digest, missing if there are none;
    ``tree_ok`` tells that the stored digests give the stored root.
    """
    about = describe(spark, store)
    schema = StructType.fromJson(about.schema.jsonValue()).add("written_by", "string").add("bucket", "integer")
    found = spark.createDataFrame([], schema)
    if exists(spark, f"{store}/data"):
        found = (spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
                 .parquet(f"{store}/data"))
    now = _leaves(found, about.schema.names).select("bucket", "written_by", F.col("digest").alias("now"))
    stored = trees(spark, store)
    leaves = stored.where("level = 0").select("version", F.col("node").alias("bucket"), "written_by", "digest", "n_rows")
    state = leaves.join(now, ["bucket", "written_by"], "left").groupBy("version").agg(
        F.count("*").alias("n_buckets"), F.count_if(F.col("now") != F.col("digest")).alias("n_changed"),
        F.count_if(F.col("now").isNull()).alias("n_missing"))
    again = _tree(leaves, about.depth, ["version"]).where(F.col("level") == about.depth).select(
        "version", F.col("digest").alias("again"))
    roots = stored.where(F.col("level") == about.depth).select("version", "digest", "n_rows")
    none = F.lit(0).cast("bigint")
    out = roots.join(state, "version", "left").join(again, "version", "left").select(
        "version", "n_rows", *[F.coalesce(c, none).alias(c) for c in ("n_buckets", "n_changed", "n_missing")],
        (F.coalesce("again", F.md5(F.lit(""))) == F.col("digest")).alias("tree_ok"))
    return out.withColumn("valid", (F.col("n_changed") == 0) & (F.col("n_missing") == 0) & F.col("tree_ok"))
