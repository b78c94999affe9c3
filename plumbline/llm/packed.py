"""Questions about many small keys, sent as packed arrays.

A task looks at a piece of a few megabytes of text at a time. What it wants to know about keys
(is this one seen elsewhere, where is it seen first) goes out as one row per piece and bucket,
with the keys and places as arrays, which costs a fraction of a row per key. Within a piece
equal keys are put together first, so that a key that is everywhere is asked once per piece.
A bucket holds the keys of about ``BUCKET_BYTES`` of text, so that it fits in a task whatever
the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import mixed, slices

BUCKET_BYTES = 96 << 20
PIECE_BYTES = 8 << 20


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, raw): the id as a long, a null one below all others, and the bytes of the text, a null one empty.

    Ids that are no whole numbers must be numbered before: text that is no number counts as null.
    """
    lowest: Column = F.lit(-(1 << 63)).cast("bigint")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), lowest).alias("sid"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("raw"))


def buckets_for(docs: DataFrame) -> int:
    """As many buckets as any shuffle has partitions, more where a bucket would get too large."""
    size = docs.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def in_order(ids: np.ndarray, shas: np.ndarray) -> list[int]:
    """Texts by id and hash, rows that share both once."""
    order = np.lexsort((shas, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (shas[order[1:]] != shas[order[:-1]])
    return order[new].tolist()


def by_bucket(bucket: np.ndarray, doc: np.ndarray, docs: list[np.ndarray], columns: list[np.ndarray]) -> Iterator[tuple]:
    """(bucket, documents' columns..., entries per document, entries' columns...) as bytes; entries come ordered by doc."""
    order = np.argsort(bucket, kind="stable")
    starts, lengths = runs(bucket[order])
    for start, length in zip(starts, lengths):
        these = order[start:start + length]
        first, count = runs(doc[these])
        which = doc[these][first]
        yield (int(bucket[these[0]]), *(d[which].tobytes() for d in docs), count.astype(np.int32).tobytes(),
               *(c[these].tobytes() for c in columns))


def unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def homes_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which the answers for a text meet."""
    return (mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def sent_home(ids: np.ndarray, columns: list[np.ndarray], buckets: int) -> list[tuple]:
    """(home, ids, counts, columns...): answers in any order, packed for the buckets of their texts."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first, count = runs(ids)
    doc = np.repeat(np.arange(len(first)), count)
    return list(by_bucket(homes_of(ids, buckets), doc, [ids[first]], [c[order] for c in columns]))


def at_home(answers: DataFrame, columns: dict[str, type]) -> DataFrame:
    """(sid, columns...): one row per text with all its answers packed, from rows of ``sent_home``."""
    names = list(columns)

    def merge(table: pa.Table) -> pa.Table:
        ids = np.repeat(unpacked(table.column("ids"), np.int64), unpacked(table.column("counts"), np.int32))
        order = np.argsort(ids, kind="stable")
        first, count = runs(ids[order])
        out = {"sid": pa.array(ids[order][first], pa.int64())}
        for name, kind in columns.items():
            values = unpacked(table.column(name), kind)[order]
            out[name] = pa.array([values[s:s + n].tobytes() for s, n in zip(first, count)], pa.binary())
        return pa.table(out)

    return answers.select("home", "ids", "counts", *names).groupBy("home").applyInArrow(
        merge, "sid bigint, " + ", ".join(f"{n} binary" for n in names))


def seen_again(texts: DataFrame, buckets: int, anchors: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]],
               piece_bytes: int = PIECE_BYTES, often: int | None = None) -> DataFrame:
    """(home, ids, counts, pos, often): the places of the keys that are seen more than once in all texts, for ``at_home``.

    ``anchors`` takes the texts of a piece and gives key (64 bits), index of the text and
    place of each, in the order of texts and places. Keys are compared by 32 bits within a
    bucket: a wrong yes is possible. With ``often`` all 64 bits are sent, and rows without home
    hold, packed, the keys seen at least so many times: at most one in ``often`` of all keys.
    """
    names = ["bucket", "ids", "counts", "keys", "pos", "known_ids", "known_counts", "known_pos"]
    types = [pa.int32()] + [pa.binary()] * 7
    kind = np.uint32 if often is None else np.uint64

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "raw", piece_bytes):
            ids = piece.column("sid").to_numpy()
            key, doc, place = anchors(piece.column("raw").to_pylist())
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            first, count = runs(key[order])
            several = np.zeros(len(key), bool)
            several[order] = np.repeat(count > 1, count)
            once = ~several
            # a key seen n times here is asked for others' sake: one entry without a text, with -n for its place
            asked = np.concatenate([key[once], key[order][first][count > 1]])
            places = np.concatenate([place[once], -count[count > 1]]).astype(np.int32)
            owner = np.concatenate([doc[once], np.full(len(asked) - once.sum(), len(ids))])
            rows = [(*r, None, None, None) for r in by_bucket(
                ((asked >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), owner, [np.append(ids, 0)], [asked.astype(kind), places])]
            rows += [(b, None, None, None, None, i, n, p) for b, i, n, p in by_bucket(
                homes_of(ids, buckets)[doc[several]], doc[several], [ids], [place[several]])]
            yield batch_of(rows, names, types)

    def answer(table: pa.Table) -> pa.Table:
        key, place = unpacked(table.column("keys"), kind), unpacked(table.column("pos"), np.int32)
        ids = np.repeat(unpacked(table.column("ids"), np.int64), unpacked(table.column("counts"), np.int32))
        order = np.argsort(key, kind="stable")
        first, count = runs(key[order])
        total = np.add.reduceat(np.where(place >= 0, 1, -place)[order], first) if len(first) else count
        many = np.zeros(0, np.uint64) if often is None else key[order][first][total >= often]
        again = order[np.repeat(total > 1, count)]
        again = again[place[again] >= 0]
        known = np.repeat(unpacked(table.column("known_ids"), np.int64), unpacked(table.column("known_counts"), np.int32))
        rows = sent_home(np.concatenate([ids[again], known]),
                         [np.concatenate([place[again], unpacked(table.column("known_pos"), np.int32)])], buckets)
        return pa.Table.from_batches([batch_of([*((*r, None) for r in rows), (None, None, None, None, many.tobytes())],
                                               ["home", "ids", "counts", "pos", "often"], [pa.int32()] + [pa.binary()] * 4)])

    asked = texts.mapInArrow(ask, "bucket int, ids binary, counts binary, keys binary, pos binary, "
                                  "known_ids binary, known_counts binary, known_pos binary")
    return asked.groupBy("bucket").applyInArrow(answer, "home int, ids binary, counts binary, pos binary, often binary")
