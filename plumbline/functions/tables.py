"""Table functions for SQL: the stability index of any table, by partition, from bins instead of rows.

``psi_bins(TABLE(...), bins)`` takes rows (key, side, value, lo, hi) and keeps counts only: an array of bins for each
key and side that its partition holds, whatever the number of rows, and lets them go beyond ``MOST`` arrays. It gives
(key, side, bin, n) for each partition, a key perhaps more than once. Partitions may cut a key in any number of
parts: rows are counted where they lie, without a shuffle or a sort, so a key with a third of all rows is many tasks' work.

``psi_of_bins(TABLE(...) PARTITION BY (...), bins)`` merges such counts and scores them. It takes any table
with ``side``, ``bin`` and ``n``, learns the other columns and their types when the query is
analysed, and returns them (one value each in a partition) with ``n_base``, ``n_target`` and ``score``.

Sides are ``base`` and ``target``; rows of other sides, null, NaN and infinite values are left out. A
range of one point has one bin and score 0, as has a key without rows on one of the sides.

Both run as ``SELECT ... FROM psi_of_bins(TABLE(SELECT key, side, bin, n FROM psi_bins(...)) PARTITION BY (key), 10)``;
``psi`` writes this statement for a view.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

SIDES = ("base", "target")
#: Arrays of counts that a task keeps before it hands them on.
MOST = 100_000


class PsiBins:
    """Counts of a partition's rows by key, side and bin."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str | None, str], np.ndarray] = {}

    def eval(self, rows: pa.RecordBatch, bins: pa.Array) -> Iterator[pa.Table]:
        if rows.num_rows:
            self._add(rows, bins[0].as_py())
        if len(self.counts) > MOST:
            yield from self.terminate()
            self.counts = {}

    def _add(self, rows: pa.RecordBatch, bins: int) -> None:
        value, lo, hi = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("value", "lo", "hi"))
        with np.errstate(divide="ignore", invalid="ignore"):
            place = np.where(hi == lo, 0, np.minimum(np.floor((value - lo) / (hi - lo) * bins), bins - 1))
        side = rows.column("side").cast(pa.string())
        base, target = (pc.fill_null(pc.equal(side, s), False).to_numpy(zero_copy_only=False) for s in SIDES)
        codes = rows.column("key").cast(pa.string()).dictionary_encode("encode")
        key = codes.indices.to_numpy()
        keep = np.isfinite(value) & np.isfinite(place) & (base | target)
        which = target.astype(np.int64)
        cell = ((key * 2 + which) * bins)[keep] + np.maximum(place[keep], 0).astype(np.int64)
        totals = np.bincount(cell, minlength=len(codes.dictionary) * 2 * bins).reshape(-1, 2, bins)
        for k, name in enumerate(codes.dictionary.to_pylist()):
            for s, side_name in enumerate(SIDES):
                if totals[k, s].any():
                    self.counts[name, side_name] = self.counts.get((name, side_name), 0) + totals[k, s]

    def terminate(self) -> Iterator[pa.Table]:
        rows = [(key, side, b, int(n)) for (key, side), counts in self.counts.items() for b, n in enumerate(counts) if n]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("key", "side", "bin", "n"), columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))})


class PsiOfBins:
    """The score of a partition's counts."""

    @staticmethod
    def analyze(counts: AnalyzeArgument, bins: AnalyzeArgument) -> AnalyzeResult:
        if not counts.isTable:
            raise ValueError("psi_of_bins takes a table of counts")
        names = counts.dataType.names
        if missing := [c for c in ("side", "bin", "n") if c not in names]:
            raise ValueError(f"psi_of_bins misses the columns {missing}")
        if not isinstance(bins.value, int) or bins.value < 1:
            raise ValueError("psi_of_bins takes a constant number of bins")
        keys = [StructField(f.name, f.dataType) for f in counts.dataType if f.name not in ("side", "bin", "n")]
        return AnalyzeResult(StructType([*keys, StructField("n_base", LongType()), StructField("n_target", LongType()), StructField("score", DoubleType())]))

    def __init__(self) -> None:
        self.keys: tuple | None = None
        self.counts: np.ndarray | None = None

    def eval(self, row, bins: int) -> None:
        if self.counts is None:
            self.counts, names = np.zeros((2, bins), np.int64), row.__fields__
            self.keys = tuple(row[n] for n in names if n not in ("side", "bin", "n"))
        if row["side"] in SIDES and row["bin"] is not None:
            self.counts[SIDES.index(row["side"]), row["bin"]] += row["n"]

    def terminate(self) -> Iterator[tuple]:
        if self.counts is None:
            return
        bins, totals = self.counts.shape[1], self.counts.sum(axis=1)
        score = 0.0
        # a range of one point fills one bin, any other its first and its last
        if totals.all() and np.count_nonzero(self.counts.sum(axis=0)) > 1:
            p, q = ((c + 1) / (t + bins) for c, t in zip(self.counts, totals))
            score = float(abs(np.sum((q - p) * np.log(q / p))))
        yield (*self.keys, int(totals[0]), int(totals[1]), score)


def register(spark: SparkSession) -> None:
    """Make both functions known to SQL."""
    spark.udtf.register("psi_bins", arrow_udtf(PsiBins, returnType="key string, side string, bin int, n bigint"))
    spark.udtf.register("psi_of_bins", udtf(PsiOfBins))


def psi(spark: SparkSession, view: str, side: str, columns: Sequence[str], by: Sequence[str] = (), bins: int = 10, parts: int | None = None) -> DataFrame:
    """(by..., attr, n_base, n_target, score): the index of each column of a view for each group, one SQL statement.

    ``side`` is an SQL expression with values ``base`` and ``target``. Ranges are those of both sides of a
    group together. ``parts`` deals each group of rows out to so many partitions; without it rows are counted where they lie.
    """
    part = f", pmod(monotonically_increasing_id(), {parts}) AS part" if parts else ""
    dealt = "PARTITION BY (key, part)" if parts else ""
    groups = "".join(f"`{c}`, " for c in by)
    # the text of a key is made once a group, and a null group is a group like any other
    key = f"to_json(struct({groups}attr))"
    same = " AND ".join([*(f"long.`{c}` <=> ranges.`{c}`" for c in by), "long.attr = ranges.attr"])
    names = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns)
    listed = ", ".join(f"`{c}`" for c in columns)
    fields = spark.table(view).schema
    types = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in by), "attr string"])
    return spark.sql(f"""
        WITH long AS (SELECT {groups}side, attr, value FROM (SELECT {groups}{side} AS side, {names} FROM `{view}`)
                      UNPIVOT (value FOR attr IN ({listed})) WHERE side IN ('base', 'target') AND abs(value) < CAST('Infinity' AS DOUBLE)),
        ranges AS (SELECT {groups}attr, {key} AS key, min(value) AS lo, max(value) AS hi FROM long GROUP BY {groups}attr),
        dealt AS (SELECT key, side, value, lo, hi{part} FROM long JOIN ranges ON {same}),
        counts AS (SELECT key, side, bin, sum(n) AS n FROM psi_bins(TABLE(SELECT * FROM dealt) {dealt}, {bins}) GROUP BY key, side, bin),
        scored AS (SELECT from_json(key, '{types}') AS k, n_base, n_target, score FROM psi_of_bins(TABLE(SELECT * FROM counts) PARTITION BY (key), {bins}))
        SELECT k.*, n_base, n_target, score FROM scored""")
