"""Repeated word windows by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one text. Every word goes that lies in a window
whose words also start earlier: in a text with a smaller id, or earlier in the same text.
Windows are judged on the input, not on what is left.

Anchors are runs of ``ANCHOR`` words at positions whose remainder modulo ``PERIOD`` is in
``COVER``. The differences of these remainders take every value, so two equal windows,
wherever they lie, have an anchor at the same place inside both:

1. All texts ask for their anchors: which are seen more than once? Less than a third of the
   positions is hashed for that, with 32 bits inside a bucket. A wrong yes costs work only.
2. Each repeated anchor is extended to the windows around it. Of these, the first of its
   words is found: (id, position) smallest. The words are compared by 128 bits.
3. The words of all other windows are removed.

Only the id and the text are read. A word is a run of bytes other than space and the control
characters 9 to 13. A null text is empty. Rows that share id and text are one text, and each
gets its result; of texts that share an id, a hash decides which is first. A null id is below
all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packed import PIECE_BYTES, at_home, batch_of, buckets_for, by_bucket, homes_of, in_order, seen_again, sent_home, source, unpacked
from .words import WordNumbers, run_hashes, slices

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1


def _text_hash(raw: bytes) -> int:
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers = WordNumbers()
    covered = np.isin(np.arange(PERIOD), COVER)
    keys, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for i, raw in enumerate(raws):
        words = numbers.of(raw.split())
        if len(words) >= WINDOW:
            at = np.flatnonzero(np.resize(covered, len(words) - ANCHOR + 1))
            keys.append(run_hashes(words, ANCHOR, 21)[at])
            docs.append(np.full(len(at), i))
            places.append(at.astype(np.int32))
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(places)


def _later_windows(extended: DataFrame, buckets: int) -> DataFrame:
    """(home, ids, counts, sha, pos): starts of the windows that start earlier elsewhere, for ``at_home``."""
    names = ["bucket", "ids", "shas", "counts", "one", "two", "pos", "known_ids", "known_counts", "known_shas", "known_pos"]
    types = [pa.int32()] + [pa.binary()] * 10

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for piece in slices(batches, "raw", PIECE_BYTES):
            raws, found = piece.column("raw").to_pylist(), piece.column("pos").to_pylist()
            ids = piece.column("sid").to_numpy()
            shas = np.array([_text_hash(raw) for raw in raws], np.int64)
            one, two, docs, places = [], [], [], []
            # in the order that decides which window is first; a repeated row has no windows of its own
            for i in in_order(ids, shas):
                words = numbers.of(raws[i].split())
                n = len(words) - WINDOW + 1
                if n <= 0:
                    continue
                anchor = np.frombuffer(found[i], np.int32)
                steps = np.bincount(np.minimum(np.maximum(anchor - (PERIOD - 1), 0), n), minlength=n + 1).astype(np.int64)
                steps -= np.bincount(np.minimum(anchor + 1, n), minlength=n + 1)
                at = np.flatnonzero(np.cumsum(steps[:n]) > 0)
                one.append(run_hashes(words, WINDOW, 22)[at])
                two.append(run_hashes(words, WINDOW, 23)[at])
                docs.append(np.full(len(at), i))
                places.append(at.astype(np.int32))
            if not one:
                continue
            a, b, doc, place = (np.concatenate(x) for x in (one, two, docs, places))
            order = np.argsort(a, kind="stable")
            later = np.zeros(len(a), bool)
            later[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            f = ~later
            rows = [(*r, None, None, None, None) for r in by_bucket(
                ((a[f] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), doc[f], [ids, shas], [a[f], b[f], place[f]])]
            rows += [(r[0], *[None] * 6, *r[1:]) for r in by_bucket(
                homes_of(ids, buckets)[doc[later]], doc[later], [ids], [shas[doc[later]], place[later]])]
            yield batch_of(rows, names, types)

    def answer(table: pa.Table) -> pa.Table:
        count = unpacked(table.column("counts"), np.int32)
        ids, shas = (np.repeat(unpacked(table.column(c), np.int64), count) for c in ("ids", "shas"))
        a, b, place = (unpacked(table.column(c), t) for c, t in (("one", np.uint64), ("two", np.uint64), ("pos", np.int32)))
        order = np.lexsort((place, shas, ids, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        # the first window itself may come twice, from rows that are repeated
        later = order[(ids[order] != ids[first]) | (shas[order] != shas[first]) | (place[order] != place[first])]
        known = np.repeat(unpacked(table.column("known_ids"), np.int64), unpacked(table.column("known_counts"), np.int32))
        rows = sent_home(np.concatenate([ids[later], known]),
                         [np.concatenate([shas[later], unpacked(table.column("known_shas"), np.int64)]),
                          np.concatenate([place[later], unpacked(table.column("known_pos"), np.int32)])], buckets)
        return pa.Table.from_batches([batch_of(rows, ["home", "ids", "counts", "sha", "pos"], [pa.int32()] + [pa.binary()] * 4)])

    asked = extended.mapInArrow(ask, "bucket int, " + ", ".join(f"{n} binary" for n in names[1:]))
    return asked.groupBy("bucket").applyInArrow(answer, "home int, ids binary, counts binary, sha binary, pos binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): the words left, joined by one space; one row per row of the input."""
    texts = source(docs, id_col, text_col)
    buckets = buckets_for(texts)
    found = at_home(seen_again(texts, buckets, _anchors).where("home IS NOT NULL"), {"pos": np.int32})
    later = at_home(_later_windows(texts.join(found, "sid"), buckets), {"sha": np.int64, "pos": np.int32})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "raw", PIECE_BYTES):
            n_words, n_removed, kept = [], [], []
            for raw, sha, pos in zip(*(piece.column(c).to_pylist() for c in ("raw", "sha", "pos"))):
                words = raw.split()
                n_words.append(len(words))
                at = np.frombuffer(pos or b"", np.int32)
                if len(at):
                    at = at[np.frombuffer(sha, np.int64) == _text_hash(raw)]
                if not len(at):
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                steps = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
                stay = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
                n_removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [piece.column("sid"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                ["sid", "n_words", "n_removed", "kept"])

    out = texts.join(later, "sid", "left").mapInArrow(cut, "sid bigint, n_words bigint, n_removed bigint, kept binary")
    id_type = dict(docs.dtypes)[id_col]
    return out.select(F.when(F.col("sid") != -(1 << 63), F.col("sid")).cast(id_type).alias("id"), "n_words", "n_removed",
                      F.col("kept").cast("string").alias("kept"))
