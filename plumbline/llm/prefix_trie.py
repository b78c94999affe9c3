"""The trie of conversations by truncation peeling.

A node of depth d stands for a sequence of d turns (role and text) with which conversations
begin; its members are all that begin so, the root stands for none and has all as members.

Each turn becomes a record of ``RECORD`` bytes (MD5 of role and text, bytes of the text), a
conversation the concatenation of its records, its path. Conversations of equal paths become
one unit with a count. Peeling then starts at the greatest depth: the nodes that survived
from the depth below and the units that end here are brought together, regrouped by their
first d turns, and lose their last turn. Members, children, leaves and savings are summed on
the way up, so each node is found and finished in the same pass.

Units are dealt out in the order of their paths, and a task peels pieces of about
``PIECE_TURNS`` turns. Within a piece all nodes are finished but those on its first and last
path, which may have members elsewhere: what hangs off them is kept as sums along these two
paths, and the two are units of the next round, until one piece holds all. So a first turn
that a third of all conversations share is spread over many tasks, and a round leaves two
paths of each piece. ``ends`` hashes the ids of the conversations that end at a node in
ascending order: they are sorted in ranges of (path, id), packed into blocks of text, and one
stream per path hashes its blocks.

Only the four named columns are read. Rows without a conversation id belong to none. A null
role or text is empty. Turns are ordered by their number, null first; turns of one
conversation that share a number are ordered by their MD5, and repeated rows are repeated
turns. A conversation's records (20 bytes a turn) must fit in a task. An empty table has no
node.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.frames import FEW_KEYS
from ..plans.scratch import bytes_of, discard, written

RECORD = 20
PIECE_TURNS = 1 << 19
CHUNK_BYTES = 32 << 20
#: Ids in a block of text that is hashed at once.
BLOCK_IDS = 512

_RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("size", ">u4")])
_NONE = np.iinfo(np.int64).max

_ENTRIES = "depths array<int>, ns array<bigint>, leasts array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<binary>"
_ROWS = ("depth bigint, conv bigint, parent bigint, parent_key binary, key binary, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, end binary, path binary, " + _ENTRIES)
_UNIT = ["path", "depths", "ns", "leasts", "kids", "leaves", "saved", "ends"]


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv, records): the records of each conversation's turns in order, as hexadecimal strings."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)),
                 F.lpad(F.hex(F.octet_length(text)), 8, "0")).alias("record"))
    in_order = F.sort_array(F.collect_list(F.struct("turn", "record")))
    return rows.groupBy("conv").agg(F.transform(in_order, lambda t: t["record"]).alias("records"))


def _ends(paths: DataFrame, chunks: int) -> DataFrame:
    """(n, least, ends): for each distinct path its conversations, the smallest id, and the hash of all ids in order."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pids = batch.column("conv").to_pylist(), batch.column("pid").to_pylist()
            starts = [i for i in range(len(pids)) if not i or pids[i] != pids[i - 1]]
            rows = [(s, min(s + BLOCK_IDS, e)) for a, e in zip(starts, [*starts[1:], len(pids)]) for s in range(a, e, BLOCK_IDS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pids[s] for s, _ in rows], pa.binary()), pa.array([ids[s] for s, _ in rows], pa.int64()),
                 pa.array([e - s for s, e in rows], pa.int64()),
                 pa.array([",".join(map(str, ids[s:e])).encode() for s, e in rows], pa.binary())], ["pid", "least", "n", "ids"])

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, n, least, hashed = None, 0, 0, sha256()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2] for r in rows], pa.binary())], ["n", "least", "ends"])

        for batch in batches:
            out = []
            for p, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("pid", "least", "n", "ids"))):
                if p == pid:
                    hashed.update(b",")
                else:
                    if pid is not None:
                        out.append((n, least, hashed.digest()))
                    pid, n, least, hashed = p, 0, first, sha256()
                hashed.update(ids)
                n += count
            yield batch_of(out)
        if pid is not None:
            yield batch_of([(n, least, hashed.digest())])

    packed = paths.select("pid", "conv").repartitionByRange(chunks, "pid", "conv").sortWithinPartitions("pid", "conv").mapInArrow(
        pack, "pid binary, least bigint, n bigint, ids binary")
    return packed.repartition("pid").sortWithinPartitions("pid", "least").mapInArrow(seal, "n bigint, least bigint, ends binary")


class _Piece:
    """Units in the order of their paths, peeled from the greatest depth upwards."""

    def __init__(self, units: pa.Table, whole: bool, keyed: bool) -> None:
        self.paths = units.column("path").to_pylist()
        self.whole, self.keyed = whole, keyed
        self.length = np.array([len(p) // RECORD for p in self.paths], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.records = np.frombuffer(b"".join(self.paths), _RECORD)
        # sums that hang off the units' paths: unit, depth and values of each, by depth
        counts = np.array([len(x) for x in units.column("depths").to_pylist()], np.int64)
        unit = np.repeat(np.arange(len(self.paths)), counts)

        def flat(name):
            return units.column(name).combine_chunks().flatten()

        depth = flat("depths").to_numpy()
        order = np.argsort(depth, kind="stable")
        self.e_unit, self.e_depth = unit[order], depth[order]
        self.e_vals = {c: flat(c).to_numpy()[order] for c in ("ns", "leasts", "kids", "leaves", "saved")}
        self.ends = flat("ends").to_pylist()
        self.e_end = np.array([i if self.ends[i] is not None else -1 for i in order], np.int64)
        self._keys: dict[int, list[bytes]] = {}

    def shared(self) -> np.ndarray:
        """Turns that each unit has in common with the one before it."""
        length, at, a, b = self.length, self.at, self.records["a"], self.records["b"]
        out = np.zeros(len(length), np.int64)
        alive, d = np.arange(1, len(length)), 0
        while len(alive):
            alive = alive[(length[alive] > d) & (length[alive - 1] > d)]
            one, two = at[alive] + d, at[alive - 1] + d
            alive = alive[(a[one] == a[two]) & (b[one] == b[two])]
            d += 1
            out[alive] = d
        return out

    def key(self, unit: int, depth: int) -> bytes:
        """Stands for the first ``depth`` turns of a unit, in all pieces."""
        if unit not in self._keys:
            hashed, keys = md5(), [md5().digest()]
            for i in range(0, len(self.paths[unit]), RECORD):
                hashed.update(self.paths[unit][i:i + RECORD])
                keys.append(hashed.copy().digest())
            self._keys[unit] = keys
        return self._keys[unit][depth]

    def peel(self) -> Iterator[tuple[list, list]]:
        """Columns of finished nodes, depth by depth; ``self.open`` then has what is left for the next round."""
        length, last = self.length, len(self.length) - 1
        shared = self.shared()
        by_length = np.argsort(length, kind="stable")
        sorted_length = length[by_length]
        top = int(sorted_length[-1])
        self.open: dict[int, list] = {} if self.whole else {0: [], last: []}
        # surviving nodes: first unit, sums, and one child each unless it is open
        reps = np.zeros(0, np.int64)
        n = leaves = saved = kid = reps
        least = reps
        waiting = None
        for d in range(top, -1, -1):
            lo, hi = np.searchsorted(sorted_length, [d, d + 1])
            met = np.concatenate([reps, by_length[lo:hi]])
            order = np.argsort(met, kind="stable")
            first = shared[met[order]] < d
            first[0] = True
            starts = met[order][first]
            group = np.empty(len(met), np.int64)
            group[order] = np.cumsum(first) - 1
            up, m = group[:len(reps)], len(starts)
            lo, hi = np.searchsorted(self.e_depth, [d, d + 1])
            to = np.searchsorted(starts, self.e_unit[lo:hi], "right") - 1

            def total(mine, entries):
                out = np.zeros(m, np.int64)
                np.add.at(out, up, mine)
                np.add.at(out, to, entries[lo:hi])
                return out

            new_n, new_kids = total(n, self.e_vals["ns"]), total(kid, self.e_vals["kids"])
            new_leaves, new_saved = total(leaves, self.e_vals["leaves"]), total(saved, self.e_vals["saved"])
            new_least = np.full(m, _NONE)
            np.minimum.at(new_least, up, least)
            np.minimum.at(new_least, to, self.e_vals["leasts"][lo:hi])
            end = np.full(m, -1)
            has = self.e_end[lo:hi] >= 0
            end[to[has]] = self.e_end[lo:hi][has]
            is_open = np.zeros(m, bool)
            owners = {}
            if not self.whole and length[last] >= d:
                owners[m - 1] = last
            if not self.whole and length[0] >= d:
                owners[0] = 0
            for g, unit in owners.items():
                is_open[g] = True
                if new_n[g] or new_kids[g] or end[g] >= 0:
                    self.open[unit].append((d, new_n[g], new_least[g], new_kids[g], new_leaves[g], new_saved[g],
                                            self.ends[end[g]] if end[g] >= 0 else None))
            if waiting is not None:
                yield self._finished(waiting, d, up, new_least, is_open, starts)
            new_leaves = np.where(new_kids == 0, 1, new_leaves)
            if d:
                new_saved = new_saved + (new_n - 1) * self.records["size"][self.at[starts] + d - 1].astype(np.int64)
            closed = ~is_open
            waiting = (d, starts, closed, new_n, new_least, new_kids, new_leaves, new_saved, end)
            reps, kid = starts, closed.astype(np.int64)
            n, leaves, saved = new_n * closed, new_leaves * closed, new_saved * closed
            least = np.where(closed, new_least, _NONE)
        yield self._finished(waiting, -1, None, None, None, None)

    def _finished(self, nodes, parent_depth, up, parent_least, parent_open, parent_start) -> list:
        d, starts, closed, n, least, kids, leaves, saved, end = nodes
        these = np.flatnonzero(closed)
        count = len(these)
        parents = keys = [None] * count
        if up is not None:
            above = up[these]
            unfinished = parent_open[above]
            parents = pa.array(parent_least[above], pa.int64(), mask=unfinished)
            keys = [self.key(int(parent_start[g]), parent_depth) if o else None for g, o in zip(above, unfinished)]
        own = [self.key(int(u), d) for u in starts[these]] if self.keyed else [None] * count
        return [np.full(count, d), least[these], parents, keys, own, n[these], kids[these], leaves[these], saved[these],
                [self.ends[i] if i >= 0 else None for i in end[these]]]


def _peeled(whole: bool, keyed: bool, piece_turns: int):
    """Rows of a partition, in the order of their paths, as finished nodes and as units (those with a path) of the next round."""
    names = ["depth", "conv", "parent", "parent_key", "key", "n_convs", "n_children", "n_leaves", "saved_tokens", "end", *_UNIT]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.list_(pa.int32()),
             *[pa.list_(pa.int64())] * 5, pa.list_(pa.binary())]
    fields = 10

    def batch(node: list | None, unit: list | None) -> pa.RecordBatch:
        size = len(node[0]) if node else len(unit[0])
        columns = [*(node or [pa.nulls(size)] * fields), *(unit or [pa.nulls(size)] * len(_UNIT))]
        return pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def work(units: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _Piece(pa.Table.from_batches(units), whole, keyed)
        for node in piece.peel():
            if len(node[0]):
                yield batch(node, None)
        if not whole:
            kept = sorted(piece.open.items())
            yield batch(None, [[piece.paths[u] for u, _ in kept], *[[[e[i] for e in entries] for _, entries in kept] for i in range(7)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, units, turns = [], 0, 0
        for arrived in batches:
            ends = np.cumsum(pa.compute.binary_length(arrived.column("path")).to_numpy(zero_copy_only=False).astype(np.int64)) // RECORD
            start, before = 0, 0
            while start < arrived.num_rows:
                # a piece has its turns, and four units at least, so that fewer are left over
                stop = arrived.num_rows
                if not whole:
                    stop = min(stop, max(int(np.searchsorted(ends, before + piece_turns - turns)) + 1, start + 4 - units))
                held.append(arrived.slice(start, stop - start))
                units, turns = units + stop - start, turns + int(ends[stop - 1]) - before
                start, before = stop, int(ends[stop - 1])
                if not whole and turns >= piece_turns and units >= 4:
                    yield from work(held)
                    held, units, turns = [], 0, 0
        if units:
            yield from work(held)

    return run


def nodes(conversations: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``conversations`` has (conv, records) as ``sequences`` makes them, one row per
    conversation. A node is named by its depth and the smallest id among its members.
    """
    spark = conversations.sparkSession
    path: Column = F.unhex(F.array_join("records", ""))
    paths = written(conversations.select("conv", path.alias("path")).withColumn("pid", F.unhex(F.md5("path"))), "paths")
    few = 2 * spark.sparkContext.defaultParallelism
    chunks = int(max(few, bytes_of(paths) // CHUNK_BYTES))
    ends = _ends(paths, chunks)
    depth = (F.octet_length("path") / RECORD).cast("int")
    zero = F.array(F.lit(0).cast("bigint"))
    units = written(ends.join(paths.select("conv", "path"), F.col("least") == F.col("conv")).select(
        "path", F.array(depth).alias("depths"), F.array("n").alias("ns"), F.array("least").alias("leasts"), zero.alias("kids"),
        zero.alias("leaves"), zero.alias("saved"), F.array("ends").alias("ends")), "units")
    discard(paths)
    done: list[DataFrame] = []
    left, size = units.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    last = False
    while not last:
        # the first round is always dealt out; afterwards what is left may fit in one piece
        known = left
        last = bool(done) and (size <= piece_turns * RECORD or left <= 4 or left >= before)
        chunks = int(min(chunks, max(1, left // 64))) if done else chunks
        dealt = units.coalesce(1) if last else units.repartitionByRange(chunks, "path")
        rows = written(dealt.sortWithinPartitions("path").mapInArrow(_peeled(last, bool(done), piece_turns), _ROWS), "trie")
        done.append(rows.where("path IS NULL"))
        units, before = rows.where("path IS NOT NULL").select(*_UNIT), known
        if not last:
            left, size = units.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    # parents that were finished in a later round than their children, two paths of each piece
    parents = every.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv").alias("later"))
    small = parents.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    found = every.where("parent_key IS NULL").withColumn("later", F.lit(None).cast("bigint")).unionByName(
        every.where("parent_key IS NOT NULL").join(F.broadcast(parents) if small else parents, "parent_key").select(*every.columns, "later"))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("parent", "later").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce(F.lower(F.hex("end")), F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of a table of turns."""
    return nodes(sequences(turns, conv_col, turn_col, role_col, text_col))
