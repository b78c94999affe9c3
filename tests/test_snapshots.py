"""Snapshots: equal to plain tables, only changed buckets are written and read, damage is found."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import snapshots
from plumbline.plans.scratch import scratch_path


def local(path):
    return path.removeprefix("file:")


def files(store):
    return {os.path.relpath(f, local(store)) for f in glob.glob(f"{local(store)}/data/*/*/*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(4000).select(
        "id", F.when(F.col("id") % 5 != 0, F.col("id") % 7).alias("n"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("p"), "id")).alias("name"))


@pytest.fixture
def store(spark, people):
    path = scratch_path(spark, "store")
    snapshots.commit(people, "id", path, "v1", 64)
    return path


def test_upsert_writes_and_diff_reads_only_what_changes(spark, people, store):
    before = files(store)
    changes = spark.createDataFrame([(17, 1, None), (9000, None, "new"), (23, 23 % 7, "p23")], "id long, n long, name string")
    snapshots.upsert(spark, store, "v1", "v2", changes, spark.createDataFrame([(40,), (41,), (123456,)], "id long"))
    added = files(store) - before
    assert before <= files(store)                       # files stay, by name
    assert len({f.split("/")[2] for f in added}) <= 6   # buckets of six keys
    want = rows(people.where("id NOT IN (17, 23, 40, 41)").unionByName(changes))
    assert rows(snapshots.read(spark, store, "v2")) == want
    assert rows(snapshots.read(spark, store, "v1")) == rows(people)
    d = snapshots.diff(spark, store, "v1", "v2")
    states = [(17, "changed"), (40, "removed"), (41, "removed"), (9000, "added")]
    if 23 % 3 != 0 and 23 % 5 != 0:
        assert rows(d) == sorted(states, key=repr)      # 23 was written again as it was
    assert len(d.inputFiles()) <= 12 < len(before) / 5
    # against the full join
    full = snapshots.compare.row_diff(people, snapshots.read(spark, store, "v2"), "id").where("state <> 'same'")
    assert rows(full) == rows(d)


def test_files_read_grow_with_the_share_of_changed_rows(spark, people, store):
    read = []
    for i, n in enumerate((1, 10, 100)):
        changes = people.where(F.col("id") < n).withColumn("name", F.lit("x"))
        snapshots.upsert(spark, store, "v1", f"n{i}", changes)
        read.append(len(snapshots.diff(spark, store, "v1", f"n{i}").inputFiles()))
    assert read[0] == 2 and read[0] < read[1] < read[2] < 2 * 64


def test_equal_rows_have_equal_roots(spark, people, store):
    other = people.where("id >= 10").withColumn("n", F.col("n"))
    snapshots.commit(other.repartition(5), "id", store, "short", 64)
    snapshots.upsert(spark, store, "short", "again", people.where("id < 10"))
    assert snapshots.changed_buckets(spark, store, "v1", "again").isEmpty()
    assert snapshots.diff(spark, store, "v1", "again").isEmpty()
    # a null that moves to the next column is another row
    swapped = people.where("id = 3").select("id", F.lit(None).cast("long").alias("n"), F.lit("3").alias("name"))
    snapshots.upsert(spark, store, "v1", "moved", swapped)
    assert rows(snapshots.diff(spark, store, "v1", "moved")) == [(3, "changed")]


def test_verify_finds_damage(spark, people, store):
    snapshots.upsert(spark, store, "v1", "v2", people.where("id < 3").withColumn("name", F.lit("x")))
    ok = {r["version"]: r for r in snapshots.verify(spark, store).collect()}
    assert all(r["valid"] for r in ok.values()) and ok["v1"]["n_rows"] == 4000
    shared = {(r["node"], r["written_by"]) for r in snapshots.trees(spark, store).where("level = 0 AND version = 'v2'").collect()}
    own = {(r["node"], r["written_by"]) for r in snapshots.trees(spark, store).where("level = 0 AND version = 'v1'").collect()}
    both, only = sorted(shared & own), sorted(own - shared)
    def part(leaf):
        return glob.glob(f"{local(store)}/data/written_by={leaf[1]}/bucket={leaf[0]}/*.parquet")[0]
    with open(part(both[0]), "r+b") as f:               # unreadable, in both snapshots
        f.truncate(10)
    people.where("id = 1").write.mode("append").parquet(  # a row too many, in the first alone
        f"{local(store)}/data/written_by={only[0][1]}/bucket={only[0][0]}")
    got = {r["version"]: r for r in snapshots.verify(spark, store).collect()}
    assert (got["v1"]["n_changed"], got["v1"]["n_missing"], got["v1"]["valid"]) == (1, 1, False)
    assert (got["v2"]["n_changed"], got["v2"]["n_missing"], got["v2"]["valid"]) == (0, 1, False)
    assert got["v1"]["tree_ok"] and got["v2"]["tree_ok"]


def test_empty_tables_and_refused_ones(spark, people, store):
    empty = scratch_path(spark, "store")
    snapshots.commit(people.limit(0), "id", empty, "v0", 8)
    assert snapshots.read(spark, empty, "v0").count() == 0
    assert rows(snapshots.verify(spark, empty)) == [("v0", 0, 0, 0, 0, True, True)]
    snapshots.upsert(spark, empty, "v0", "v1", people.where("id < 2"))
    assert rows(snapshots.diff(spark, empty, "v0", "v1")) == [(0, "added"), (1, "added")]
    snapshots.upsert(spark, empty, "v1", "v2", people.limit(0), people.select("id"))
    assert snapshots.changed_buckets(spark, empty, "v0", "v2").isEmpty()
    for bad, message in ((people.unionByName(people.where("id = 1")), "occurs 2 times"),
                         (people.withColumn("id", F.when(F.col("id") > 0, F.col("id"))), "None occurs"),
                         (people.withColumn("more", F.lit(1)), "another key, schema"),
                         (people.withColumn("bucket", F.lit(1)), "belong to the store")):
        with pytest.raises(ValueError, match=message):
            snapshots.commit(bad, "id", store, "v9", 64)
    with pytest.raises(ValueError, match="exists"):
        snapshots.commit(people, "id", store, "v1", 64)
    with pytest.raises(ValueError, match="unknown snapshot"):
        snapshots.read(spark, store, "v9")
