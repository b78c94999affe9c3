"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared as letters and digits in lower case with one space for anything between
them. A benchmark item of ``WHOLE`` characters or more is looked for by three overlapping
halves, a shorter one as a whole; an item of ``RUN`` characters or more besides by pieces of 150
that start every 50 and at its end. Such a passage of m characters may differ by k edits, 8 % of m.
Every run of ``RUN`` characters of an item holds a whole piece, so a copy of it that differs by at
most 12 edits, the k of a piece, is found wherever the run lies and however long the item is.

1. Lemma: a text within k edits of a passage holds at least m + 1 - q - kq places whose q-gram the
   passage has as well, on diagonals that differ by at most k. Such places are counted in bands of
   2(k + 1) diagonals, each overlapping the next by half, so that some band holds them all.
2. Bands that reach the count are kept, neighbours among them as one region, and the text around a
   region is aligned with the passage, in blocks that overlap by more than a passage; at most k edits
   are a hit. Pieces are aligned only where neither a half nor the whole of the item is found in the text.

The grams are stored once per item: a gram in the text counts for all passages that hold its place
in the item, if the text has as many grams of the item as its least demanding passage asks for.
Places of one gram that lie so close in an item that their diagonals fill adjoining bands are
stored as one run, and a place of the text counts once in all bands of the run, as two changes of a
count that are added up later. So zeros, dotted lines and repeated words cost no more than the
runs they make. Pairs of places and runs are worked through ``PAIRS`` at a time.

Items of fewer than ``SHORT`` characters carry too little to be found inside a text: they match
only a text that is nothing else. Empty items and null or empty texts match nothing.

The index of the benchmark is broadcast. It holds at most ``INDEX_CHARS`` characters; a larger
benchmark is worked through in several parts, each over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import mixed, odd_numbers, slices

Q = 10
EDITS = 0.08
WHOLE, SHORT = 160, 24
RUN, LENGTH, STEP = 200, 150, 50
INDEX_CHARS = 8 << 20
PIECE = 2 << 20
#: Pairs of a place and a run or a passage that are expanded at once, and characters that are aligned at once.
PAIRS, BLOCK = 1 << 17, 1 << 17
SPACE, BORDER = 32, 1


def letters() -> np.ndarray:
    """Lower case of every letter and digit of the basic plane, 0 for all else."""
    out = np.zeros(1 << 16, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalnum():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def normal(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each between borders: codes, the place of each in its text, and where each text starts."""
    codes, origin, starts = [], [], []
    at = 0
    for text in texts:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.where(raw < len(table), table[np.minimum(raw, len(table) - 1)], raw)
        gap = low == 0
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        place = np.flatnonzero(keep)
        low = low[place]
        low[low == 0] = SPACE
        if len(low) and low[-1] == SPACE:
            low, place = low[:-1], place[:-1]
        codes += [np.array([BORDER], np.uint32), low]
        origin += [np.array([-1]), place]
        starts.append(at)
        at += 1 + len(low)
    codes.append(np.array([BORDER], np.uint32))
    origin.append(np.array([-1]))
    return np.concatenate(codes), np.concatenate(origin), np.array(starts)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """64 bits of the q-gram that starts at each place."""
    x = mixed(codes.astype(np.uint64))
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a, b, c, d = odd_numbers(4, 91)
    two = x[:-1] * a + x[1:]
    four = two[:-2] * b + two[2:]
    eight = four[:-4] * c + four[4:]
    total = eight[:n] * d + two[8:8 + n]
    return total ^ (total >> np.uint64(31))


def build_index(texts: list[str]) -> SimpleNamespace:
    """The passages and the q-grams of the items with where these are; plain values, since broadcasts carry no code."""
    table = letters()
    items, item, short = [], [], {}
    passages, begin, owner, piece = [], [], [], []
    at = 0
    for i, text in enumerate(texts):
        codes = normal([text], table)[0][1:-1]
        m = len(codes)
        if m == 0:
            continue
        if m < SHORT:
            short.setdefault(codes.tobytes(), []).append(i)
            continue
        half = m // 2
        wide = [(0, m)] if m < WHOLE else [(s, half) for s in (0, (m - half) // 2, m - half)]
        narrow = [] if m < RUN else [(s, LENGTH) for s in [*range(0, m - LENGTH, STEP), m - LENGTH]]
        for s, size in wide + narrow:
            passages.append(codes[s:s + size])
            begin.append(at + s)
            owner.append(len(items))
        piece += [False] * len(wide) + [True] * len(narrow)
        items.append(codes)
        item.append(i)
        at += m
    sizes = np.array([len(p) for p in passages], np.int64)
    edits = np.minimum((sizes * EDITS).astype(np.int64), np.maximum(sizes - Q, 0) // Q)
    least, begin, owner, piece = sizes + 1 - Q - edits * Q, np.array(begin, np.int64), np.array(owner, np.int64), np.array(piece, bool)
    asked = np.full(len(items), at + 1, np.int64)
    np.minimum.at(asked, owner, least)
    hashed = [gram_hashes(p) for p in items]
    grams = np.concatenate([np.zeros(0, np.uint64), *hashed])
    starts = np.cumsum([0, *[len(p) for p in items]])
    place = np.concatenate([np.zeros(0, np.int64), *[s + np.arange(len(h)) for s, h in zip(starts, hashed)]])
    order = np.argsort(grams, kind="stable")
    grams, place = grams[order], place[order]
    # runs of a gram's places in an item whose diagonals fill adjoining bands of each of its passages
    close = np.full(len(items), at + 1, np.int64)
    np.minimum.at(close, owner, edits + 1)
    own = np.searchsorted(starts, place, "right") - 1
    new = np.ones(len(place), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1]) | (np.diff(place) > close[own[1:]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(place)) - 1 if len(head) else head
    unique, first, count = np.unique(grams[head], return_index=True, return_counts=True)
    known = np.zeros(1 << 20, bool)
    known[(unique >> np.uint64(44)).astype(np.int64)] = True
    index = SimpleNamespace(passages=passages, item=np.array(item, np.int64), owner=owner, piece=piece, begin=begin, end=begin + sizes, edits=edits, least=least, asked=asked,
                           layers=[np.flatnonzero(~piece), np.flatnonzero(piece)], grams=unique, first=first, count=count, low=place[head], high=place[tail],
                           run_item=own[head], known=known, short=short)
    # what a place of the text with a gram expands to: its runs and their passages
    runs = np.arange(len(head))
    index.work = np.add.reduceat(1 + sum(_held(runs, layer, index)[1] for layer in index.layers), first) if len(first) else first
    return index


def _held(run: np.ndarray, layer: np.ndarray, index: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """First passage of a layer that holds a q-gram of each run, and how many do; passages of a layer begin and end in the same order."""
    first = np.searchsorted(index.end[layer], index.low[run] + Q, "left")
    return first, np.maximum(np.searchsorted(index.begin[layer], index.high[run], "right") - first, 0)


def holding(run: np.ndarray, index: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``run``, passage) for every passage that holds a q-gram of a run."""
    out = []
    for layer in index.layers:
        first, many = _held(run, layer, index)
        held = np.repeat(np.arange(len(run)), many)
        out.append((held, layer[np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(held))] if len(held) else held))
    return tuple(np.concatenate(part) for part in zip(*out))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    keys, values = (np.concatenate([np.zeros(0, np.int64), *column]) for column in (zip(*parts) if parts else ((), ())))
    unique, which = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(unique), np.int64)
    np.add.at(sums, which, values)
    return unique, sums


def aligned(passage: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int] | None:
    """Fewest edits that turn the passage into some part of the text, and where that part ends; None above ``edits``."""
    columns = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, code in enumerate(passage):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != code), row[1:] + 1)
        row = np.minimum.accumulate(new - columns) + columns
        if row.min() > edits:
            return None
    end = int(row.argmin())
    return int(row[end]), end


def _hits(texts: list[str], index: SimpleNamespace, table: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end): the best hit of each item in each text, by code points of the text."""
    codes, origin, starts = normal(texts, table)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    sizes = np.diff(np.append(starts, len(codes) - 1)) - 1
    for t in np.flatnonzero((sizes > 0) & (sizes < SHORT)):
        own = slice(starts[t] + 1, starts[t] + 1 + sizes[t])
        for i in index.short.get(codes[own].tobytes(), []):
            best[int(t), i] = (0, int(origin[own][0]), int(origin[own][-1]) + 1)
    wide_found = None
    for p, first, last in sorted(_bands(codes, starts, index), key=lambda band: bool(index.piece[band[0]])):
        if index.piece[p] and wide_found is None:
            wide_found = set(best)
        wanted, k = index.passages[p], int(index.edits[p])
        low, high = first * (k + 1) - k, (last + 2) * (k + 1) + len(wanted) + k
        middle = min(max((low + high) // 2, 0), len(codes) - 1)
        # the texts that the region touches, as a rule one
        for t in range(max(int(np.searchsorted(starts, max(low, 0), "right")) - 1, 0), int(np.searchsorted(starts, max(high, middle), "left"))):
            a, z = max(low, int(starts[t]) + 1), min(high, int(starts[t]) + 1 + int(sizes[t]))
            slot = (t, int(index.item[index.owner[p]]))
            if wide_found and slot in wide_found:
                continue
            for block in range(a, max(z - len(wanted) - k, a) + 1, BLOCK):
                stop = min(z, block + BLOCK + 2 * (len(wanted) + k))
                # nothing further on is better than a hit without edits
                if stop - block < len(wanted) - k or (slot in best and best[slot][0] == 0 and best[slot][1] <= origin[block]):
                    break
                hit = aligned(wanted, codes[block:stop], k)
                if hit:
                    end = block + hit[1]
                    begin = max(a, end - len(wanted))
                    new = (hit[0], int(origin[begin]), int(origin[end - 1]) + 1)
                    best[slot] = min(best.get(slot, new), new)
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def _bands(codes: np.ndarray, starts: np.ndarray, index: SimpleNamespace) -> list[tuple[int, int, int]]:
    """(passage, first, last): the bands next to each other in which enough places of the texts share a q-gram with the passage."""
    hashed = gram_hashes(codes)
    at = np.flatnonzero(index.known[(hashed >> np.uint64(44)).astype(np.int64)])
    if not len(at) or not len(index.grams):
        return []
    which = np.minimum(np.searchsorted(index.grams, hashed[at]), len(index.grams) - 1)
    same = index.grams[which] == hashed[at]
    at, which = at[same], which[same]
    text = np.searchsorted(starts, at, "right") - 1
    ends = np.cumsum(index.work[which])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) if len(ends) else 0, PAIRS)), [0, len(at)]))

    def pairs():
        """(place, text, run), a bounded number at a time."""
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            times = index.count[which[lo:hi]]
            mine = np.repeat(np.arange(lo, hi), times)
            yield at[mine], text[mine], np.repeat(index.first[which[lo:hi]] - np.cumsum(times) + times, times) + np.arange(len(mine))

    # only texts with as many q-grams of an item as some passage of it must share
    shared = added([np.unique(index.run_item[run] << 32 | t, return_counts=True) for _, t, run in pairs()])
    kept = shared[0][shared[1] >= index.asked[shared[0] >> 32]]
    changes = []
    for a, t, run in pairs() if len(kept) else ():
        key = index.run_item[run] << 32 | t
        good = kept[np.minimum(np.searchsorted(kept, key), len(kept) - 1)] == key
        a, run = a[good], run[good]
        held, passage = holding(run, index)
        a, run, wide = a[held], run[held], index.edits[passage] + 1
        # each diagonal lies in two overlapping bands; a run's diagonals fill all between its first and its last
        nearest = np.maximum(index.low[run], index.begin[passage]) - index.begin[passage]
        furthest = np.minimum(index.high[run], index.end[passage] - Q) - index.begin[passage]
        begins, stops = (a - furthest) // wide - 1, (a - nearest) // wide + 1
        key = np.concatenate([passage, passage]) << 40 | (np.concatenate([begins, stops]) + (1 << 30))
        changes.append(added([(key, np.repeat(np.array([1, -1]), len(passage)))]))
        if len(changes) > 64:
            changes = [added(changes)]
    key, change = added(changes)
    passage, band = key >> 40, (key & ((1 << 40) - 1)) - (1 << 30)
    # the changes of a passage add up to nothing
    enough = np.cumsum(change) >= index.least[passage]
    first = np.flatnonzero(enough & ~np.concatenate([[False], enough[:-1]]))
    last = np.flatnonzero(enough & ~np.concatenate([enough[1:], [False]]))
    return [(int(passage[f]), int(band[f]), int(band[n + 1]) - 1) for f, n in zip(first, last)]


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the benchmark, in parts of bounded size."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // INDEX_CHARS) or 1
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").collect()
        if rows or part == 0:
            yield [r.item for r in rows], [r.text for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, edits, start, end): per row and benchmark item found in it the best hit."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("raw", F.col("text").cast("binary")).drop("text")
    id_type, item_type = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    out = None
    for ids, texts in _parts(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast((ids, build_index(texts)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = letters()
            names, index = shared.value
            kind = None
            for piece in slices(batches, "raw", PIECE):
                hits = _hits([(x or b"").decode("utf-8", "replace") for x in piece.column("raw").to_pylist()], index, table)
                kind = kind or (pa.infer_type(names) if names else pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id").take(pa.array([h[0] for h in hits], pa.int64())), pa.array([names[h[1]] for h in hits], kind),
                     *(pa.array([h[c] for h in hits], pa.int64()) for c in (2, 3, 4))], ["id", "item", "edits", "start", "end"])

        found = source.mapInArrow(search, f"id {id_type}, item {item_type}, edits bigint, start bigint, end bigint")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The rows in which no benchmark item is found, with all their columns."""
    for _, texts in _parts(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(texts))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = letters()
            for batch in batches:
                sized = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text_col).cast(pa.binary())], ["row", "raw"])
                keep = np.ones(batch.num_rows, bool)
                for piece in slices(iter([sized]), "raw", PIECE):
                    rows = piece.column("row").to_numpy()
                    for hit in _hits([(x or b"").decode("utf-8", "replace") for x in piece.column("raw").to_pylist()], shared.value, table):
                        keep[rows[hit[0]]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
