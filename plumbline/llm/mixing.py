"""A training mix of sources with weights that change over time.

1. Each source gets a target in words: its weight's part of ``share`` times all words, but at
   most ``most`` times what it has; what is over goes to the others by weight, until none is
   above (the level at which it stops is found from running sums over the sources).
2. The documents of a source follow each other in a fixed pseudo-random order (MD5 of the id),
   pass after pass. A copy is taken if the middle of its words lies within the target, so a
   source's words miss the target by half a document at most.
3. A source's weight over training time is a line through knots. Its integral is the demand,
   and a copy's position in time, from 0 to 1, is where the demand reaches the words before its
   middle: the inverse of the integral.
4. Copies are range-sorted by position.

Running sums come from range chunks, so a source with most of the rows is spread over many
tasks. Sources are told apart by code points, null last; a null id has a place like any other,
a null or empty text has no words and costs nothing. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import scan
from ..plans.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
#: (time, factor) of each weight in turn: one fades out, one grows, one stays.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> (source, turn, target); one row per source."""
    everything = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = (sizes.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1))
               .withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight")))
    # sources in the order in which they would reach their caps; each sees the level that the ones before it leave
    before = everything.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    left = (weighed.withColumn("total", total)
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
            .withColumn("capped", F.col("level") >= F.col("ratio")))
    level = ((F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything))
             / F.nullif(F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything), F.lit(0.0)))
    return left.withColumn("level", level).select(
        "source", "turn", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def position(demand: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which a weight that follows the knots has asked for this part of its total demand."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, done = sum(areas), 0.0
    out = F.lit(knots[-1][0])
    pieces = []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        slope = (w1 - w0) / (t1 - t0)
        rest = demand * total - done
        time = t0 + (rest / w0 if slope == 0 else (F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))) - w0) / slope)
        pieces.append((done + area, time))
        done += area
    for upto, time in reversed(pieces):
        out = F.when(demand * total <= upto, time).otherwise(out)
    return F.least(F.greatest(out, F.lit(knots[0][0])), F.lit(knots[-1][0]))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, most: int = MOST, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, positions): where in time the copies of each row stand."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = written(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("place")), "sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    summed = scan(rows, ["source"], ["place", "id", "size", "text_hash"], running={"upto": F.col("size")}, plain_bytes=0)
    aims = aims.select(F.col("source").alias("of"), "turn", "target")
    placed = summed.join(aims, F.col("source").eqNullSafe(F.col("of")))

    def middle(copy: Column) -> Column:
        return copy * F.col("upto_total") + (F.col("upto") - F.col("size")) + F.col("size") / 2

    def when_asked(copy: Column) -> Column:
        demand = middle(copy) / F.nullif(F.col("target"), F.lit(0.0))
        out = F.lit(0.0)
        for i in range(len(weights)):
            out = F.when(F.col("turn") == i, position(demand, schedules[i % len(schedules)])).otherwise(out)
        return F.coalesce(out, F.lit(0.0))

    copies = F.filter(F.array(*[F.lit(float(k)) for k in range(most)]), lambda k: middle(k) <= F.col("target"))
    return placed.select("id", "source", "text_hash", "size", F.col("upto_total").alias("source_size"), "target",
                         F.transform(copies, when_asked).alias("positions"))


def in_training_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: all columns of each copy taken and its ``position``, range-sorted by it.

    Of rows that share id, source and text but differ in other columns any one stands for all.
    """
    key = ["id", "source", "text_hash"]
    placed = (mix(docs, id_col, source_col, text_col, **options).groupBy(*key)
              .agg(F.flatten(F.collect_list("positions")).alias("positions"), F.count("*").alias("rows")).where("size(positions) > 0"))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{source_col}`").alias("row_source"),
                       F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("row_hash"))
    joined = rows.join(placed, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash"))
                       & F.col("row_source").eqNullSafe(F.col("source")))
    # repeated rows have their copies listed together
    once, several = joined.where("rows = 1"), joined.where("rows > 1").dropDuplicates(["row_id", "row_source", "row_hash"])
    copies = once.unionByName(several).select("row.*", F.explode("positions").alias("position"))
    return copies.repartitionByRange("position").sortWithinPartitions("position")
