"""Ordered computations over groups too large for one task.

A window partitioned by a key puts the whole group of that key into one task.
Here the rows are range-partitioned by key and order instead, so that a hot key
is spread over many chunks; each chunk is scanned on its own and the totals of
the chunks before it (at most one row per key and chunk) are added.
The chunk number is written with the rows: it must not change when a task is run again.
Rows that take no more than ``PLAIN_BYTES`` in all are scanned by a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import bytes_of, discard, written

#: Bytes on disk of a chunk, and of the pieces into which a small table is cut for all cores.
CHUNK_BYTES, SMALL_BYTES = 16 << 20, 128 << 10
#: Bytes on disk of a whole table up to which a key may lie in one task: half a chunk.
PLAIN_BYTES = CHUNK_BYTES // 2


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 chunks: int | None = None) -> DataFrame:
    """Rows range-partitioned by (keys, order) with the partition as ``_chunk``.

    ``order`` must be unique inside a key, or equal rows stay in one chunk. The rows are
    written first: what they take on disk gives the number of chunks, about ``CHUNK_BYTES``
    each however many there are, and Spark's sample for the ranges reads them from there.
    """
    return _chunked(written(df, "rows"), keys, order, chunks)


def _chunked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None) -> DataFrame:
    """The chunks of written rows, which go."""
    size = bytes_of(rows)
    few = min(2 * rows.sparkSession.sparkContext.defaultParallelism, size // SMALL_BYTES + 1)
    n = chunks or int(max(few, size // CHUNK_BYTES))
    cols = [F.col(c) for c in (*keys, *order)]
    out = written(rows.repartitionByRange(n, *cols).withColumn("_chunk", F.spark_partition_id()), "chunks")
    discard(rows)
    return out


def _plain(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str],
           running: Sequence[str], lead: Mapping[str, str], lag: Mapping[str, str]) -> DataFrame:
    """``scan`` of few rows: one window per key."""
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    in_order = by_key.orderBy(*order)
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*columns, *[F.sum(f"_in_{k}").over(by_key).alias(f"{k}_total") for k in running],
                       *[F.sum(f"_in_{k}").over(upto).alias(k) for k in running],
                       *[F.lead(c).over(in_order).alias(k) for k, c in lead.items()],
                       *[F.lag(c).over(in_order).alias(k) for k, c in lag.items()])


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
         running: Mapping[str, Column | str] | None = None,
         lead: Mapping[str, str] | None = None,
         lag: Mapping[str, str] | None = None,
         chunks: int | None = None, plain_bytes: int = PLAIN_BYTES) -> DataFrame:
    """Running sums, next and previous values per key in the given order.

    With ``plain_bytes`` of 0, or a number of chunks, a small table is cut into chunks too. ``running`` adds ``name`` (inclusive sum) and ``name_total`` (sum of the key);
    ``lead``/``lag`` add the value of a column in the next/previous row.
    """
    running, lead, lag = dict(running or {}), dict(lead or {}), dict(lag or {})
    expr = {k: (F.col(v) if isinstance(v, str) else v) for k, v in running.items()}
    rows = written(df.select("*", *[v.alias(f"_in_{k}") for k, v in expr.items()]), "rows")
    if chunks is None and bytes_of(rows) <= plain_bytes:
        return _plain(rows, df.columns, keys, order, list(expr), lead, lag)
    chunked = _chunked(rows, keys, order, chunks)
    group = [*keys, "_chunk"]
    pos = F.struct(*order)
    aggs = [F.sum(f"_in_{k}").alias(f"_sum_{k}") for k in expr]
    aggs += [F.min_by(F.struct(c), pos).alias(f"_first_{k}") for k, c in lead.items()]
    aggs += [F.max_by(F.struct(c), pos).alias(f"_last_{k}") for k, c in lag.items()]
    per_chunk = chunked.groupBy(*group).agg(*aggs)
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    in_order = by_key.orderBy("_chunk")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    cols: list[Column] = []
    for k in expr:
        cols += [F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}"),
                 F.sum(f"_sum_{k}").over(by_key).alias(f"{k}_total")]
    cols += [F.lead(f"_first_{k}").over(in_order).alias(f"_next_{k}") for k in lead]
    cols += [F.lag(f"_last_{k}").over(in_order).alias(f"_prev_{k}") for k in lag]
    offsets = per_chunk.select(*[F.col(g).alias(f"_k_{g}") for g in group], *cols)
    local = Window.partitionBy(*group).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    # a null key is a key like any other
    same = [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in keys] + [F.col("_chunk") == F.col("_k__chunk")]
    joined = chunked.join(offsets, reduce(and_, same))
    out = [F.col(c) for c in df.columns]
    out += [F.col(f"{k}_total") for k in expr]
    out += [(F.col(f"_off_{k}") + F.sum(f"_in_{k}").over(upto)).alias(k) for k in expr]
    out += [F.coalesce(F.lead(F.struct(c)).over(local), F.col(f"_next_{k}"))[c].alias(k)
            for k, c in lead.items()]
    out += [F.coalesce(F.lag(F.struct(c)).over(local), F.col(f"_prev_{k}"))[c].alias(k)
            for k, c in lag.items()]
    return joined.select(*out)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos",
             chunks: int | None = None) -> DataFrame:
    """Row number from 0 per key (``name``) and the row count of the key (``name_total``)."""
    out = scan(df, keys, order, running={name: F.lit(1).cast("bigint")}, chunks=chunks)
    return out.withColumn(name, F.col(name) - 1)


def halo_blocks(df: DataFrame, pos: str, size: Column | int, before: Column | int,
                after: Column | int, total: str | None = None) -> DataFrame:
    """Cut numbered rows into blocks of ``size``, each with its neighbours' edge rows.

    ``total`` names the column with the row count of the series; without it a block of
    edge rows alone may follow the last one.

    Adds ``block`` and ``own``; a row shows up as ``own`` in exactly one block and as
    a halo row in the blocks that look ``before``/``after`` rows over their edge.
    """
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    size, before, after = lit(size), lit(before), lit(after)
    first = F.greatest(F.floor((F.col(pos) - after) / size), F.lit(0))
    last = F.floor((F.col(pos) + before) / size)
    if total is not None:
        last = F.least(last, F.floor((F.col(total) - 1) / size))
    return (df.withColumn("block", F.explode(F.sequence(first, last)))
            .withColumn("own", F.col("block") == F.floor(F.col(pos) / size)))
