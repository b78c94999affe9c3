"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. All distinct blocks are sorted (by their
first bytes, a hash, and then all bytes) and numbered, so a block's name is an integer that only equal blocks share. Then adjacent names
are paired, the distinct pairs sorted and numbered, and so on until one name is left per
text. Texts are equal if and only if they have as many blocks and the same last name.

Blocks are told apart by their bytes. Two 64-bit hashes only find a block's name again
without moving its bytes another time; that is exact as long as no two distinct blocks share
both, which is looked up, and if some do, the names are found by the bytes.

Columns other than the two named ones are not read. A null text counts as empty, an empty
text is one empty block. Rows that share id and text are one row with several copies; rows
that share only the id are different rows. A null id sorts below every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import written

BLOCK_BYTES = 16 * 1024


def _named(distinct: DataFrame, order: list[str], keep: list[str], name: str) -> DataFrame:
    """Distinct rows sorted and numbered, written once so that a repeated task can't number them anew.

    All but the last sort key deal out the ranges: where they are short, Spark's sample of
    the keys stays small however long the last one is.
    """
    dealt = distinct.repartitionByRange(*order[:-1]).sortWithinPartitions(*order)
    return written(dealt.select(*keep, (F.monotonically_increasing_id() + 1).alias("name")), name)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").alias("id"), raw.alias("raw")).select("id", F.sha2("raw", 256).alias("sha"), "raw")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(id, sha, n, pos, h1, h2, block): the blocks of every text; an empty text has one."""
    n: Column = F.greatest(F.ceil(F.octet_length("raw") / size), F.lit(1)).cast("int")
    return (rows.withColumn("n", n).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .withColumn("block", F.substring("raw", F.col("pos") * size + 1, F.lit(size))).drop("raw")
            .withColumn("h1", F.xxhash64("block")).withColumn("h2", F.xxhash64(F.lit("other"), "block", F.octet_length("block"))))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, sha, copies, n, name): equal (n, name) if and only if equal text; one row per id and text."""
    blocks = _blocks(_rows(docs, id_col, text_col), block_bytes)
    names = _named(blocks.groupBy("h1", "h2", "block").agg(F.substring("block", 1, 16).alias("head")),
                   ["head", "h1", "block"], ["h1", "h2"], "block-names")
    keys = ["h1", "h2"]
    if not names.groupBy(*keys).count().where("count > 1").isEmpty():
        names = _named(blocks.groupBy("block").agg(F.substring("block", 1, 16).alias("head"), F.first("h1").alias("h1")),
                       ["head", "h1", "block"], ["block"], "block-names")
        keys = ["block"]
    # a text's blocks are alike in all its copies, so the copies are counted here once
    level = written(blocks.select("id", "sha", "n", "pos", *keys).join(names, keys)
                    .groupBy("id", "sha", "n", "pos", "name").agg(F.count("*").alias("copies")), "names")
    done = level.where("n = 1").drop("pos")
    level = level.where("n > 1")
    most = level.agg(F.max("n")).first()[0] or 1
    while most > 1:
        pair = (level.groupBy("id", "sha", "copies", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                     F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")))
        names = _named(pair.groupBy("a", "b").agg(F.lit(0).alias("last")), ["a", "b", "last"], ["a", "b"], "pair-names")
        level = written(pair.join(names, ["a", "b"]).select("id", "sha", "n", "pos", "name", "copies"), "names")
        most = (most + 1) // 2
    return done.unionByName(level.drop("pos"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, sha, copies, group_size, keep_id): of equal texts the largest id is to be kept.

    One row per id and text, with the number of such rows in ``copies``; ``group_size`` counts every row.
    """
    every = identities(docs, id_col, text_col, block_bytes)
    groups = every.groupBy("n", "name").agg(F.sum("copies").alias("group_size"), F.max("id").alias("keep_id"))
    return every.join(groups, ["n", "name"]).select("id", "sha", "copies", "group_size", "keep_id")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that stay, with all their columns: one row for each different text.

    Of rows that share id and text but differ in other columns any one stays.
    """
    stay = exact_groups(docs, id_col, text_col, block_bytes).where("id <=> keep_id").select("id", "sha", "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("row_id"),
                       F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("row_sha"))
    kept = rows.join(stay, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_sha") == F.col("sha")))
    once = kept.where("copies = 1")
    again = kept.where("copies > 1").dropDuplicates(["row_id", "row_sha"])
    return once.unionByName(again).select("row.*")
