"""Near duplicates by MinHash: minima, bands, verification, components.

A document's set holds the distinct 2-word shingles of its lower-cased (A-Z) words; one word
alone is a shingle of its own. Documents whose sets share at least ``SIMILAR`` percent of
their union are linked, and a group is what links connect.

- Documents of equal sets form one class; all else works on classes.
- 128 minima of universal hashes (multiply, add, shift) in 32 bands of 4: a pair at the
  threshold misses every band with probability (1 - 0.8^4)^32 = 5e-8.
- Within a bucket of a band all are first compared with one pivot, the member that meets most
  others in its buckets: the original of a group of near copies, as a rule. Components are
  then formed. Where the members of a bucket still lie in several, all outside the largest are
  compared with all members of other components, in blocks of bounded size that hold their
  sets; a pair is looked at in the first bucket that it shares. So a large group of near
  copies costs a star and the few that the star does not reach, and no link between
  components is lost.
- A pair is compared by set sizes, then by one byte of each minimum (128 x 0.8 matches are
  expected at the threshold; fewer than 75 come with probability 1e-8, so that bands and bytes
  together miss a pair at the threshold with probability 6e-8), then by the full sets.
- Components come from alternating large-star and small-star steps.

Only the id and the text are read. A null or empty text, or one without words, has an empty
set and is linked with nothing. Rows may share an id; a null id is never the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import discard, written
from .words import WordNumbers, mixed, odd_numbers, slices

SIMILAR = 80
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SKETCH_MATCHES = 75
#: Shingles in a block of a bucket that is compared at once.
BLOCK_SHINGLES = 1 << 20
#: A bucket is hot with more than one part in so many of a task's fair share of rows.
HOT_PARTS = 4


def shingles(text: bytes | None, numbers: WordNumbers) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    words = numbers.of((text or b"").lower().split())
    if len(words) == 0:
        return words
    first, second = (np.uint64(int(x)) for x in odd_numbers(2, 11))
    pairs = words[:1] * first if len(words) == 1 else words[:-1] * first + words[1:] * second + np.uint64(1)
    return np.unique(mixed(pairs))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, bands, sketch) of every row; digest stands for the set, sketch holds a byte of each minimum."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    id_type = dict(source.dtypes)["id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        times, plus = odd_numbers(HASHES, 1)[:, None], odd_numbers(HASHES, 2)[:, None]
        band_times = odd_numbers(ROWS, 3)
        band_no = odd_numbers(BANDS, 4)
        for batch in slices(batches, "raw"):
            n, digest, bands, sketch = [], [], [], []
            for text in batch.column("raw").to_pylist():
                found = shingles(text, numbers)
                n.append(len(found))
                digest.append(blake2b(found.tobytes(), digest_size=16).digest())
                if len(found) == 0:
                    bands.append([])
                    sketch.append(b"")
                    continue
                minima = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(found), 2048):
                    hashed = found[at:at + 2048] * times
                    hashed += plus
                    minima = np.minimum(minima, hashed.min(axis=1))
                minima >>= np.uint64(24)
                keys = mixed((minima.reshape(BANDS, ROWS) * band_times).sum(axis=1) * np.uint64(2) + band_no)
                bands.append(keys.view(np.int64))
                sketch.append(mixed(minima).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["id", "n", "digest", "bands", "sketch"])

    return source.mapInArrow(sign, f"id {id_type}, n bigint, digest binary, bands array<bigint>, sketch binary")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): the smallest node that each node is connected with, by large-star and small-star steps."""
    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        near = large.join(least, large["u"] == least["c"])
        small = (near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))).distinct()
        old, edges = edges, written(small, "edges")
        before, now = now, state(edges)
        discard(old)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _similar(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    def side(c: str) -> DataFrame:
        return classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sketch_a", "sketch_b"))
                yield batch.filter(pa.array((a == b).sum(axis=1) >= SKETCH_MATCHES)).select(["a", "b"])

    sized = (pairs.join(side("a"), "a").join(side("b"), "b")
             .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR).select("a", "b", "sketch_a", "sketch_b"))
    close = sized.mapInArrow(alike, "a bigint, b bigint")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_a"):
            keep = []
            for set_a, set_b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                one, two = np.frombuffer(set_a, np.uint64), np.frombuffer(set_b, np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(shared * 100 >= (len(one) + len(two) - shared) * SIMILAR)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def full(c: str) -> DataFrame:
        return sets.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}"))

    both = close.join(full("a"), "a").join(full("b"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(confirm, "a bigint, b bigint")


def _across(open_: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that may be similar: all but those that surely are not.

    ``open_`` has (bucket, cls, comp, main): main is the component that most members of the bucket belong to.
    """
    spark = open_.sparkSession
    rows = open_.join(classes.select("cls", "n", "sketch", "bands"), "cls").withColumn("out", F.col("comp") != F.col("main"))
    sizes = rows.groupBy("bucket").agg(F.sum("n").alias("all_n"), F.count("*").alias("all_rows"),
                                       F.sum(F.col("out").cast("int")).alias("outs"), F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("out_n"))

    def parts(n: str, count: str, most_rows: int):
        return F.ceil(F.greatest(F.col(n) / BLOCK_SHINGLES, F.col(count) / most_rows))

    sizes = written(sizes.select("bucket", F.col("all_rows").alias("size"), parts("out_n", "outs", 512).alias("outer"),
                                 parts("all_n", "all_rows", 2048).alias("inner")), "sizes")
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // BLOCK_SHINGLES))
    # small buckets share groups, a large one is cut into blocks of outer and inner parts
    cut = _by_bucket(rows, sizes.drop("size"), _hot(sizes, count)).withColumn("alone", (F.col("outer") > 1) | (F.col("inner") > 1)).withColumn(
        "grp", F.when(F.col("alone"), F.col("bucket")).otherwise(F.pmod("bucket", F.lit(groups))))
    hashed = F.xxhash64("cls")
    as_outer = cut.where("out").withColumn("o", F.pmod(hashed, "outer")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("inner") - 1)))
    as_inner = cut.withColumn("i", F.pmod(hashed, "inner")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outer") - 1)))
    blocks = (as_outer.withColumn("role", F.lit(True)).unionByName(as_inner.withColumn("role", F.lit(False)))
              .join(sets, "cls").select("grp", "o", "i", "bucket", "cls", "comp", "role", "n", "sketch", "bands", "set"))

    def compare(table: pa.Table) -> pa.Table:
        bucket, cls, comp, n = (table.column(c).to_numpy() for c in ("bucket", "cls", "comp", "n"))
        role = table.column("role").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        packed = table.column("set").to_pylist()
        a, b = [], []
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1, append=bucket[order[-1]] + 1))
        for start, end in zip(edges[:-1], edges[1:]):
            these = order[start:end]
            inner, outer = these[~role[these]], these[role[these]]
            if not len(inner):
                continue
            # halves of the numbers: as many or more are found in common, never fewer
            halves = [np.frombuffer(packed[j], np.uint64).astype(np.uint32) for j in inner]
            outs = set(cls[outer].tolist())
            is_out = np.array([c in outs for c in cls[inner].tolist()], bool)
            for x in outer:
                small, large = np.minimum(n[inner], n[x]), np.maximum(n[inner], n[x])
                # of two outsiders the lower one asks; outsiders of another outer part are asked from both sides
                may = np.flatnonzero((comp[inner] != comp[x]) & (small * 100 >= large * SIMILAR) & ~(is_out & (cls[inner] < cls[x])))
                may = may[(sketch[inner[may]] == sketch[x]).sum(axis=1) >= SKETCH_MATCHES]
                if not len(may):
                    continue
                common = bands[inner[may]] == bands[x]
                may = may[bands[x][common.argmax(axis=1)] == bucket[x]]
                if not len(may):
                    continue
                own = np.unique(np.frombuffer(packed[x], np.uint64).astype(np.uint32))
                joined = np.concatenate([halves[j] for j in may])
                at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                shared = np.add.reduceat((own[at] == joined).astype(np.int64), np.cumsum([0, *[len(halves[j]) for j in may[:-1]]]))
                good = may[shared * 100 >= (n[inner[may]] + n[x] - shared) * SIMILAR]
                a += [int(cls[x])] * len(good)
                b += cls[inner[good]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("grp", "o", "i").applyInArrow(compare, "a bigint, b bigint").distinct()


def _hot(buckets: DataFrame, rows: int) -> DataFrame:
    """(bucket): those that hold so large a part of all rows that a task would feel it; there are at most ``HOT_PARTS`` for each task."""
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return buckets.where(F.col("size") * (HOT_PARTS * tasks) > rows).select("bucket")


def _by_bucket(rows: DataFrame, per_bucket: DataFrame, hot: DataFrame) -> DataFrame:
    """Join on the bucket; rows of hot buckets stay where they are, so none of these is one task's work."""
    known = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    told = rows.join(known, "bucket", "left")
    large = per_bucket.join(known, "bucket", "left_semi")
    return told.where("is_hot IS NULL").drop("is_hot").join(per_bucket, "bucket").unionByName(
        told.where("is_hot").drop("is_hot").join(F.broadcast(large), "bucket"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, component): set size and the smallest id of the row's group, one row per row of the input."""
    signed = written(signatures(docs, id_col, text_col), "signatures")
    classes = written(signed.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("least"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    hot = written(_hot(shared, shared.agg(F.sum("size")).first()[0] or 0), "hot")
    met = written(_by_bucket(members, shared, hot), "met")
    meets = written(met.groupBy("cls").agg(F.sum("size").alias("meets")), "meets")
    pivots = written(met.join(meets, "cls").groupBy("bucket").agg(F.max_by("cls", F.struct("meets", -F.col("cls"))).alias("pivot")), "pivots")
    buckets = written(_by_bucket(met.select("bucket", "cls"), pivots, hot), "buckets")
    discard(met, shared, pivots)
    sets = _sets(docs, id_col, text_col, classes.join(meets, "cls").select("cls", "digest", "least"))

    pairs = buckets.where("cls <> pivot").select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct()
    links = written(_similar(pairs, classes, sets), "links")
    # class -> component, where it is not the class itself
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = buckets.join(roots, buckets["cls"] == roots["node"], "left").select("bucket", "cls", "pivot", F.coalesce("root", "cls").alias("comp"))
    # the pivot of a bucket has met all its members
    left = written(placed.where("cls <> pivot").select("bucket", "cls", "comp"), "left")
    sizes = left.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    spread = (sizes.groupBy("bucket").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1")
              .select("bucket", "main"))
    open_ = written(_by_bucket(left, spread, hot), "open")
    if not open_.isEmpty():
        more = written(_similar(_across(open_, classes, sets), classes, sets), "links")
        roots = components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
        discard(more)
    groups = written(_placed_rows(signed, classes, roots), "groups")
    discard(signed, classes, hot, meets, buckets, sets, links, left, open_)
    return groups


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(cls, set): the packed set of each of the wanted classes."""
    source = docs.select(F.col(f"`{id_col}`").alias("least"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    found = source.join(wanted, source["least"].eqNullSafe(wanted["least"])).select("cls", "digest", "raw")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows may share an id: only a text of the class itself stands for it."""
        numbers = WordNumbers()
        for batch in slices(batches, "raw"):
            sets = [shingles(text, numbers).tobytes() for text in batch.column("raw").to_pylist()]
            keep = [blake2b(s, digest_size=16).digest() == digest for s, digest in zip(sets, batch.column("digest").to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.binary())], ["cls", "set"])
            yield out.filter(pa.array(keep, pa.bool_()))

    # repeated rows leave the same set twice
    return written(found.mapInArrow(make, "cls bigint, set binary").dropDuplicates(["cls"]), "sets")


def _placed_rows(signed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = classes.join(roots, classes["cls"] == roots["node"], "left").select("digest", "least", F.coalesce("root", "cls").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_digest = rooted.join(lowest, "root").select(F.col("digest").alias("of"), "component")
    # rows without words share a digest that no class has; they stay out of the join
    placed = signed.where("n > 0").join(by_digest, F.col("digest") == F.col("of")).select("id", "n", "digest", "component")
    return placed.unionByName(signed.where("n = 0").select("id", "n", "digest", F.col("id").alias("component")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: those with the smallest id of their group.

    Rows that share this id stay together, unless their texts are equal: of these any one
    stays, whatever its other columns hold.
    """
    groups = near_groups(docs, id_col, text_col)
    stay = written(groups.where("id <=> component").groupBy("id").agg(F.count("*").alias("copies")), "stay")
    discard(groups)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("row_id"))
    same = F.col("row_id").eqNullSafe(F.col("id"))
    kept = rows.join(stay.where("copies = 1"), same, "left_semi").select("row")
    several = stay.where("copies > 1")
    if not several.isEmpty():
        again = rows.withColumn("sha", F.sha2(F.col(f"row.`{text_col}`"), 256)).join(several, same, "left_semi").dropDuplicates(["row_id", "sha"])
        kept = kept.unionByName(again.select("row"))
    return kept.select("row.*")
