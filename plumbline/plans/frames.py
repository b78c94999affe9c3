"""Shapes shared by the operators: long form, two sides, exact samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import cut, pieces

BASE = "base"
TARGET = "target"


def r(col: Column | str, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def two_sides(base: DataFrame, target: DataFrame) -> DataFrame:
    return base.withColumn("side", F.lit(BASE)).unionByName(
        target.withColumn("side", F.lit(TARGET)))


def split_sides(df: DataFrame, is_base: Column, is_target: Column) -> DataFrame:
    """Label the rows of one scan; rows on neither side are dropped by the filter."""
    return (df.where(is_base | is_target)
            .withColumn("side", F.when(is_base, F.lit(BASE)).otherwise(F.lit(TARGET))))


def to_long(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ("side",)) -> DataFrame:
    """One row per (row, attribute) with a double value; nulls, NaN and infinities are dropped.

    All attributes then share one aggregation instead of one job each.
    """
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    # also false for null and NaN, which sorts above infinity
    finite = F.abs("value") < float("inf")
    return wide.unpivot(list(ids), list(columns), "attr", "value").where(finite)


def one_row(*parts: DataFrame) -> DataFrame:
    """Join one-row results side by side through scalar subqueries."""
    spark = parts[0].sparkSession
    names = [f"_p{i}" for i in range(len(parts))]
    structs = [p.select(F.struct(*[F.col(f"`{c}`") for c in p.columns])).scalar().alias(n)
               for p, n in zip(parts, names)]
    packed = spark.range(1).select(*structs)
    return packed.select(*[F.col(f"{n}.`{c}`").alias(c) for p, n in zip(parts, names) for c in p.columns])


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach every column of a one-row frame to each row, without a join."""
    packed = scalars.select(F.struct(*scalars.columns)).scalar()
    return (df.withColumn("_one", packed)
            .select(*df.columns, *[F.col(f"_one.`{c}`").alias(c) for c in scalars.columns]))


def sample_order(key: Column | str, seed: int = 42) -> Column:
    """Repeatable pseudo-random order of rows: md5 of seed and key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hand out the rows by key where the input comes in fewer pieces than half the cores.

    For work that is heavy per row. Large inputs come in enough pieces and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, key)


def grouped(df: DataFrame, *keys: str):
    """Groups for a Python function, over as many partitions as any shuffle has.

    Spark merges small partitions by their bytes, which leaves heavy work on few bytes
    to few tasks; a given number of partitions stays as it is.
    """
    return df.repartition(pieces(df), *keys).groupBy(*keys)


#: Rows up to which a table of one row per key is broadcast.
FEW_KEYS = 100_000


def join_few(rows: DataFrame, per_key: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Join rows with a table that has one row per key, without moving the rows if the keys are few.

    Few keys are likely hot ones: a shuffle on them would put most rows into a few tasks. The
    table is kept and counted; beyond ``FEW_KEYS`` rows the join is Spark's, by shuffle, where a
    key that is hot among so many is split at run time.
    """
    per_key = cut(per_key)
    few = per_key.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return rows.join(F.broadcast(per_key) if few else per_key, on)


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(sample_order(key, seed), key).limit(n)


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds of a timestamp column; one without time zone does not depend on the session's."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))
