"""Agglomerative clusters in two dimensions: single linkage, cut at k clusters, without a table of all pairs.

Joining the nearest two clusters again and again is the same as taking the links of the minimum
spanning tree by length; k clusters are left when the k - 1 longest links are not taken. Only a
few of the links need to be known for that:

1. Cells of a side S, halved until the filled cells fall into k groups or more that do not touch. Then
   places that touching cells of side S / 3 join are joined before the cut as well, since all
   these links are shorter than S. They become components.
2. The shortest link between each two components is found, up to a length at which fewer than k
   are left (or, with many components, at first up to twice that of the cells). Links of that
   length touch neighbouring cells only. A box of points stands for its points: a pair of boxes
   farther apart than the best link known between its components is settled, the others are
   parted into smaller boxes, until so few places are left in both that their pairs are looked at.
3. The spanning tree of these links is made; its longest links go. Graphs of at most ``ONE_TASK`` links, each of them
   between components and not between rows, are worked through in order by one task; beyond that, label exchange
   and Borůvka rounds do the same, which are many jobs. Every job takes memory of the driver for its plan and its compiled code.

Links are ordered by squared length, then by the smaller and the greater key of their ends, so the
result does not depend on the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.components import connected_components
from ..plans.frames import FEW_KEYS, join_few
from ..plans.scratch import written

# boxes are parted by four on each axis; places closer than 1 / 4 ** 30 of a cell's side are one box
DEEPEST = 30
# cells an axis in the first grid, and components whose pairs are few enough to look at all of them
GRID, MANY = 16, (3 * 16 + 1) ** 2
# a pair of boxes with at most this many pairs of places is not parted any more, its pairs are looked at
BLOCK = 4096
# links between components (a few dozen bytes each) up to which one task makes their spanning tree
ONE_TASK = 200_000


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder. A checkpoint would keep what Spark knows of the columns' values, which grows
    with each round of joins until planning takes longer than the work."""
    return written(df, "linkage")


def _few(links: DataFrame) -> bool:
    return links.limit(ONE_TASK + 1).count() <= ONE_TASK


def _joined(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b), or (a, b, d2, p, q) -> (v, component): ends joined in the order of the links, ``most`` times at most."""
    found = list(batches)
    if not any(b.num_rows for b in found):
        return
    links = pa.Table.from_batches(found)
    if "d2" in links.column_names:
        links = links.sort_by([(c, "ascending") for c in ("d2", "p", "q")])
    ends = pa.chunked_array([*links["a"].chunks, *links["b"].chunks]).unique()
    ends = ends.take(pc.sort_indices(ends))
    root = list(range(len(ends)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    left = len(ends) if most is None else most
    for a, b in zip(*(pc.index_in(links[c], value_set=ends).to_pylist() for c in ("a", "b"))):
        a, b = top(a), top(b)
        if a != b:
            if not left:
                break
            left -= 1
            root[max(a, b)] = min(a, b)
    names = ends.take(pa.array([top(i) for i in range(len(ends))], pa.int64()))
    yield pa.RecordBatch.from_arrays([ends, names], ["v", "component"])


def _in_one_task(links: DataFrame, most: int | None = None) -> DataFrame:
    """(v, component) of the ends of at most ``ONE_TASK`` links, named by their smallest member."""
    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(lambda batches: _joined(batches, most), f"v {kind}, component {kind}")


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v) and (a, b) -> (v, component): the smallest vertex reachable from v."""
    links = cut(links.select("a", "b"))
    if not _few(links):
        return connected_components(vertices, links)
    return vertices.join(_in_one_task(links), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def touching(places: DataFrame, x0: float, y0: float, side: float) -> DataFrame:
    """(key, x, y) -> (key, x, y, c): components of places in cells that touch, named by their smallest key."""
    p = places.select("key", "x", "y", F.floor((F.col("x") - x0) / side).cast("bigint").alias("cx"),
                      F.floor((F.col("y") - y0) / side).cast("bigint").alias("cy"))
    cells = cut(p.groupBy("cx", "cy").agg(F.min("key").alias("v")))
    around = cells.select(F.col("v").alias("a"), F.explode(F.array(*[
        F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("t"))
    links = around.select("a", "t.cx", "t.cy").join(cells.withColumnRenamed("v", "b"), ["cx", "cy"]).select("a", "b")
    names = components(cells.select("v"), links).withColumnRenamed("component", "c")
    return p.join(cells.join(names, "v"), ["cx", "cy"]).select("key", "x", "y", "c")


def _squared(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def closest_links(places: DataFrame, reach: float) -> DataFrame:
    """(key, x, y, c) -> (a, b, link): the least link (d2, least key, greatest key) up to ``reach`` between each two components.

    A cell must hold few components, as it does if places closer than a fixed part of ``reach`` share one.
    """
    side = reach * 1.001  # so that rounding puts no link farther than the next cell
    located = cut(places.select("key", "x", "y", "c", F.floor(F.col("x") / side).cast("bigint").alias("cx"),
                                F.floor(F.col("y") / side).cast("bigint").alias("cy")))

    def at(axis: str, deep: int) -> Column:
        return F.floor((F.col(axis) - F.col(f"c{axis}") * side) / (side / 4 ** deep)).cast("bigint")

    def box(deep: int) -> Column:
        return F.struct("cx", "cy", at("x", deep).alias("sx"), at("y", deep).alias("sy"))

    def boxes(level: int, wanted: DataFrame | None = None) -> DataFrame:
        """Boxes of a level, with the box of the level above that holds them; quarters of a width nest exactly."""
        rows = located.select("key", "x", "y", "c", box(max(level - 1, 0)).alias("above"), box(level).alias("box"))
        if wanted is not None:
            rows = rows.join(wanted, ["c", "above"], "left_semi")
        return rows.groupBy("c", "above", "box").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.min(F.struct("key", "x", "y")).alias("rep"), F.count("*").alias("n"))

    def side_of(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col("c").alias(name), F.col("above").alias(f"{name}_above"), *[
            F.col(c).alias(f"{name}_{c}") for c in ("box", "x0", "x1", "y0", "y1", "rep", "n")])

    def judged(both: DataFrame) -> DataFrame:
        def gap(d: str) -> Column:
            return F.greatest(F.col(f"a_{d}0") - F.col(f"b_{d}1"), F.col(f"b_{d}0") - F.col(f"a_{d}1"), F.lit(0.0))

        return both.select("a", "b", "a_box", "b_box", _squared(gap("x"), gap("y")).alias("low"),
                           (F.col("a_n") * F.col("b_n")).alias("n"), link("rep")).where(F.col("low") <= reach * reach)

    def link(name: str) -> Column:
        a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
        return F.struct(_squared(a["x"] - b["x"], a["y"] - b["y"]).alias("d2"), F.least(a["key"], b["key"]).alias("p"),
                        F.greatest(a["key"], b["key"]).alias("q")).alias("link")

    def least(links: DataFrame) -> DataFrame:
        return links.groupBy("a", "b").agg(F.min("link").alias("link"))

    def looked_at(few: DataFrame, level: int) -> DataFrame:
        """The least links of pairs of boxes of a level, over all pairs of their places."""
        at_home = located.select("c", box(level).alias("box"), F.struct("key", "x", "y").alias("place"))
        for name in "ab":
            few = few.join(at_home.select(F.col("c").alias(name), F.col("box").alias(f"{name}_box"), F.col("place").alias(f"{name}_place")),
                           [name, f"{name}_box"])
        return least(few.select("a", "b", link("place")))

    step = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    first = cut(boxes(0))
    around = (side_of(first, "a").withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
              .withColumn("cx", F.col("a_box.cx") + F.col("dx")).withColumn("cy", F.col("a_box.cy") + F.col("dy")))
    target = side_of(first, "b").withColumn("cx", F.col("b_box.cx")).withColumn("cy", F.col("b_box.cy"))
    pairs = cut(judged(around.join(target, ["cx", "cy"]).where(F.col("a") < F.col("b"))))
    best = cut(least(pairs))
    for level in range(DEEPEST):
        few = best.limit(FEW_KEYS + 1).count() <= FEW_KEYS
        left = cut(pairs.where("n > 1").drop("link").join(F.broadcast(best) if few else best, ["a", "b"])
                   .where(F.col("low") <= F.col("link.d2")).drop("low", "link"))
        if left.isEmpty():
            break
        best = best.unionByName(looked_at(left.where(F.col("n") <= BLOCK).drop("n"), level))
        left = left.where(F.col("n") > BLOCK)
        wanted = left.select(F.col("a").alias("c"), F.col("a_box").alias("above")).unionByName(
            left.select(F.col("b").alias("c"), F.col("b_box").alias("above"))).distinct()
        smaller = boxes(level + 1, wanted)
        parents = left.select("a", "b", F.col("a_box").alias("a_above"), F.col("b_box").alias("b_above"))
        pairs = cut(judged(parents.join(side_of(smaller, "a"), ["a", "a_above"]).join(side_of(smaller, "b"), ["b", "b_above"])))
        best = cut(least(best.unionByName(least(pairs))))
    return best.where(F.col("link.d2") <= reach * reach)


def spanning_forest(links: DataFrame) -> DataFrame:
    """(a, b, link) -> those of the minimum spanning forest; ``link`` orders them, no two are alike.

    Each round takes the least link of every component, joins what it connects, and drops links
    inside components; the components at least halve.
    """
    still = cut(links.select("a", "b", "link", F.col("a").alias("u"), F.col("b").alias("v")))
    taken = still.select("a", "b", "link").limit(0)
    while not still.isEmpty():
        ends = still.unionByName(still.select("a", "b", "link", F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(ends.groupBy("u").agg(F.min(F.struct("link", "a", "b", "v")).alias("m")).select("u", "m.*"))
        taken = cut(taken.unionByName(least.select("a", "b", "link").distinct()))
        names = cut(connected_components(least.select(F.col("u").alias("v")), least.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        for end in ("u", "v"):
            still = join_few(still, names.select(F.col("v").alias(end), F.col("component").alias(f"new_{end}")), end)
        still = cut(still.where("new_u <> new_v").select("a", "b", "link", F.col("new_u").alias("u"), F.col("new_v").alias("v")))
    return taken


def single_linkage(points: DataFrame, k: int | None = None) -> DataFrame:
    """(key, x, y) -> (key, x, y, cluster): k agglomerative clusters by single linkage, named by their smallest key.

    Default k = min(5, rows // 2); below 2 all is one cluster. Rows at one place are never parted, so
    fewer places than k give a cluster each. Rows without finite coordinates have no cluster (null).
    Keys are unique and not null.
    """
    rows = cut(points.select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    # false for null and NaN, which sorts above infinity
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    places = cut(rows.where(finite).groupBy("x", "y").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    shape = places.agg(F.count("*").alias("places"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("key").alias("key"), F.min("x").alias("x0"),
                       F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    k = min(5, shape["rows"] // 2) if k is None else k
    if k < 2 or shape["places"] <= k:
        named = places.select("x", "y", (F.lit(shape["key"]) if k < 2 else F.col("key")).alias("cluster"))
    else:
        named = _cut_at(places.drop("n"), k, shape["x0"], shape["y0"], max(shape["x1"] - shape["x0"], shape["y1"] - shape["y0"]))
    placed = rows.where(finite).join(named, ["x", "y"]).select("key", "x", "y", "cluster")
    return placed.unionByName(rows.where(~F.coalesce(finite, F.lit(False))).withColumn("cluster", F.lit(None)))


def _nearest_joined(links: DataFrame, most: int) -> DataFrame:
    """(v, component) of the ends of the links after joining what the ``most`` shortest links of their spanning forest connect."""
    if _few(links):
        return _in_one_task(links.select("a", "b", "link.*"), most)
    forest = spanning_forest(links)
    found = forest.count()
    if found > most:  # fewer than k links stay away
        away = forest.orderBy(F.desc("link")).limit(found - most).select("a", "b")
        forest = forest.join(F.broadcast(away), ["a", "b"], "left_anti")
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    return connected_components(ends, forest)


def _cut_at(places: DataFrame, k: int, x0: float, y0: float, extent: float) -> DataFrame:
    """(x, y, cluster) of more than k places."""
    side, longest = extent / GRID, 1.5 * extent
    while touching(places, x0, y0, side).agg(F.count_distinct("c")).first()[0] < k:
        # links inside such a group are no longer than the diagonal of two cells
        side, longest = side / 2, math.sqrt(8) * 1.001 * side
        if side < extent / 2 ** 50:
            raise ValueError("places differ by less than the last bits of the coordinates' range")
    parts, reach = cut(touching(places, x0, y0, side / 3)), side
    n = parts.select("c").distinct().count()
    while n > k:
        reach = longest if n <= MANY else min(2 * reach, longest)
        names = cut(_nearest_joined(cut(closest_links(parts, reach)), n - k))
        ends, found = names.agg(F.count("*"), F.count("*") - F.count_distinct("component")).first()
        if found:
            names = names.withColumnRenamed("v", "c")  # few names are likely hot ones, a shuffle would put most places into a few tasks
            parts = cut(parts.join(F.broadcast(names) if ends <= FEW_KEYS else names, "c", "left").select(
                "key", "x", "y", F.coalesce("component", "c").alias("c")))
        n -= found
    return parts.select("x", "y", F.col("c").alias("cluster"))
