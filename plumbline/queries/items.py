"""Items, boxes, samples and splits on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from .profiles import ITEMS_CTE, part_items
from ..operators import items, sampling
from ..plans.frames import r
from ..plans.scratch import scratch_path

NAMES = ["small", "red", "blue", "ring", "widget"]
_COLS = "key, id, coalesce(split, '') AS split, array_to_string(classes, ' ') AS classes"


def flat(df, *more):
    return df.select("key", "id", F.coalesce("split", F.lit("")).alias("split"),
                     F.array_join("classes", " ").alias("classes"), *more)


@query("item_filter_page", f"""WITH {ITEMS_CTE}, f AS (SELECT * FROM it WHERE split = 'train' AND list_contains(classes, 'ring'))
SELECT {_COLS}, (SELECT count(*) FROM f) AS total FROM f ORDER BY path LIMIT 50 OFFSET 5""")
def item_filter_page(spark, sf):
    found = items.filter_items(part_items(spark, sf), "train", 3, NAMES)
    return flat(items.page(found, "path", 50, 5), "total")


@query("item_preview", f"""WITH {ITEMS_CTE} SELECT {_COLS}, filename, width, height FROM it
WHERE id = substr(md5('train/images/img_13.jpg'), 1, 12)""")
def item_preview(spark, sf):
    import hashlib
    wanted = hashlib.md5(b"train/images/img_13.jpg").hexdigest()[:12]
    return flat(items.preview(part_items(spark, sf), wanted), "filename", "width", "height")


def chosen(spark, sf, mod, rest):
    return part_items(spark, sf).where(F.col("key") % mod == rest).select("id")


@query("items_relabel", f"""WITH {ITEMS_CTE} SELECT key, id, coalesce(split, '') AS split,
 array_to_string(CASE WHEN key % 3 = 1 THEN list_transform(classes, lambda c: 'blue') ELSE classes END, ' ') AS classes,
 key % 3 = 1 AS relabeled FROM it""")
def items_relabel(spark, sf):
    return flat(items.relabel(part_items(spark, sf), chosen(spark, sf, 3, 1), "blue", NAMES), "relabeled")


@query("items_move", f"""WITH {ITEMS_CTE} SELECT key, id, CASE WHEN key % 3 = 1 THEN 'test' ELSE coalesce(split, '') END AS split,
 array_to_string(classes, ' ') AS classes, key % 3 = 1 AND split IS DISTINCT FROM 'test' AS moved, '' AS unknown FROM it
UNION ALL SELECT NULL, 'no-such-item', '', '', false, 'unknown id'""")
def items_move(spark, sf):
    ids = chosen(spark, sf, 3, 1).unionByName(spark.range(1).select(F.lit("no-such-item").alias("id")))
    it = part_items(spark, sf)
    moved = flat(items.move(it, ids, "test"), "moved", F.lit("").alias("unknown"))
    lost = items.unknown_ids(it, ids).select(
        F.lit(None).cast("bigint").alias("key"), "id", F.lit("").alias("split"), F.lit("").alias("classes"),
        F.lit(False).alias("moved"), F.lit("unknown id").alias("unknown"))
    return moved.unionByName(lost)


@query("items_add", f"""WITH {ITEMS_CTE} SELECT {_COLS} FROM it WHERE key % 4 <> 0
UNION ALL SELECT key, id, 'valid', array_to_string(classes, ' ') FROM it WHERE key % 4 = 0""")
def items_add(spark, sf):
    it = part_items(spark, sf)
    return flat(items.add(it.where("key % 4 <> 0"), it.where("key % 4 = 0"), "valid"))


@query("items_remove", f"""WITH {ITEMS_CTE} SELECT {_COLS}, '' AS unknown FROM it WHERE key % 3 <> 1
UNION ALL SELECT NULL, 'no-such-item', '', '', 'unknown id'""")
def items_remove(spark, sf):
    ids = chosen(spark, sf, 3, 1).unionByName(spark.range(1).select(F.lit("no-such-item").alias("id")))
    it = part_items(spark, sf)
    lost = items.unknown_ids(it, ids).select(
        F.lit(None).cast("bigint").alias("key"), "id", F.lit("").alias("split"), F.lit("").alias("classes"),
        F.lit("unknown id").alias("unknown"))
    return flat(items.remove(it, ids), F.lit("").alias("unknown")).unionByName(lost)


def part_boxes(spark, sf):
    """One box per part; every eleventh picture has no known size."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("item"), (F.col("p_size") % 5).alias("class_id"),
        ((k % 37) / 100 + 0.3).alias("cx"), ((k % 23) / 100 + 0.4).alias("cy"),
        ((k % 11 + 1) / 50).alias("w"), ((k % 13 + 1) / 60).alias("h"),
        F.when(k % 11 == 5, 0).otherwise(F.col("p_size") * 10).alias("width"), (F.col("p_size") * 5 + 3).alias("height"),
        F.when(k % 4 == 3, "valid").otherwise("train").alias("split"), F.concat(F.lit("img_"), (k - k % 3).cast("string"), F.lit(".jpg")).alias("filename"))


BOXES = """bx AS (SELECT p_partkey AS item, p_size % 5 AS class_id, (p_partkey % 37) / 100 + 0.3::DOUBLE AS cx,
 (p_partkey % 23) / 100 + 0.4::DOUBLE AS cy, (p_partkey % 11 + 1) / 50 AS w, (p_partkey % 13 + 1) / 60 AS h,
 CASE WHEN p_partkey % 11 = 5 THEN 0 ELSE p_size * 10 END AS width, p_size * 5 + 3 AS height FROM part)"""


@query("bbox_yolo_to_coco", f"""WITH {BOXES} SELECT item, class_id, CASE WHEN item % 4 = 3 THEN 'valid' ELSE 'train' END AS split,
 round((cx - w / 2) * width, 4) + 0.0 AS x, round((cy - h / 2) * height, 4) + 0.0 AS y, round(w * width, 4) AS box_w, round(h * height, 4) AS box_h,
 round(w * width * (h * height), 4) AS area, row_number() OVER (ORDER BY item) AS annotation_id
FROM bx WHERE width > 0 AND height > 0""")
def bbox_yolo_to_coco(spark, sf):
    path = scratch_path(spark, "coco")
    items.write_coco(items.boxes_to_coco(part_boxes(spark, sf), ["item", "split"]), path)
    b = spark.read.schema("id bigint, image_id bigint, category_id int, bbox array<double>, area double, split string").json(path)
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    return b.select(F.col("image_id").alias("item"), F.col("category_id").alias("class_id"), "split", F.col("id").alias("annotation_id"),
                    *[r(c, 4).alias(n) for c, n in ((x, "x"), (y, "y"), (w, "box_w"), (h, "box_h"), (F.col("area"), "area"))])


@query("bbox_yolo_to_voc", f"""WITH {BOXES} SELECT 'img_' || (item - item % 3) || '.jpg' AS filename, 'class_' || class_id AS class, CASE WHEN item % 4 = 3 THEN 'valid' ELSE 'train' END AS split,
 width::INTEGER AS width, height::INTEGER AS height, CAST(trunc((cx - w / 2) * width) AS INTEGER) AS xmin,
 CAST(trunc((cy - h / 2) * height) AS INTEGER) AS ymin, CAST(trunc((cx + w / 2) * width) AS INTEGER) AS xmax,
 CAST(trunc((cy + h / 2) * height) AS INTEGER) AS ymax FROM bx WHERE width > 0 AND height > 0""")
def bbox_yolo_to_voc(spark, sf):
    path = scratch_path(spark, "voc")
    boxes = items.boxes_to_voc(part_boxes(spark, sf), ["class_id", "split", "filename", "width", "height"])
    items.write_voc(boxes, spark.createDataFrame([], "class_id int, name string"), path)
    box = "xmin: int, ymin: int, xmax: int, ymax: int"
    records = spark.read.format("xml").option("rowTag", "annotation").schema(
        f"filename string, size struct<width: int, height: int>, object array<struct<name: string, bndbox: struct<{box}>>>, split string").load(path)
    return records.select("filename", "split", "size.*", F.explode("object").alias("o")).select(
        "filename", F.col("o.name").alias("class"), "split", "width", "height", "o.bndbox.*")


@query("export_splits", f"""WITH {ITEMS_CTE}, e AS (SELECT *, coalesce(split, 'train') AS s FROM it),
l AS (SELECT unnest(['yolo', 'coco', 'voc']) AS layout)
SELECT layout, id, s AS split,
 CASE layout WHEN 'yolo' THEN s || '/images/' || filename WHEN 'coco' THEN 'images/' || s || '/' || filename
  ELSE 'JPEGImages/' || filename END AS target_path,
 CASE layout WHEN 'yolo' THEN s || '/labels/img_' || key || '.txt' WHEN 'coco' THEN 'annotations/instances_' || s || '.json'
  ELSE 'Annotations/img_' || key || '.xml' END AS label_target
FROM e CROSS JOIN l WHERE s IN ('train', 'valid')""")
def export_splits(spark, sf):
    it = part_items(spark, sf)
    out = None
    for layout in ("yolo", "coco", "voc"):
        path = scratch_path(spark, f"export-{layout}")
        items.write_export(items.export_splits(it, layout, ["train", "valid"]).select("id", "split", "target_path", "label_target"), path)
        e = spark.read.parquet(path).select(F.lit(layout).alias("layout"), "id", "split", "target_path", "label_target")
        out = e if out is None else out.unionByName(e)
    return out


# ---- samples ---------------------------------------------------------------

def line_key():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def keyed_lines(spark, sf):
    return table(spark, sf, "lineitem").select(line_key().alias("line"), "l_returnflag", "l_extendedprice")


@query("sample_random", f"""SELECT {LINE_KEY} AS line, l_returnflag, l_extendedprice FROM lineitem
ORDER BY md5('42:' || {LINE_KEY}), 1 LIMIT 100""")
def sample_random(spark, sf):
    return sampling.sample_random(keyed_lines(spark, sf), 100, "line")


@query("sample_stratified", f"""WITH x AS (SELECT {LINE_KEY} AS line, l_returnflag, l_extendedprice,
 count(*) OVER (PARTITION BY l_returnflag) AS n, count(*) OVER () AS total FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42:' || line), line) AS rn FROM x)
SELECT line, l_returnflag, l_extendedprice, l_returnflag AS stratum FROM k WHERE rn <= greatest(1, floor(500 * n / total))""")
def sample_stratified(spark, sf):
    return sampling.sample_stratified(keyed_lines(spark, sf), F.col("l_returnflag"), 500, "line")


@query("sample_threshold", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 5000")
def sample_threshold(spark, sf):
    return sampling.sample_threshold(table(spark, sf, "documents"), "n_chars", 500, 5000).select("doc_id", "n_chars")


@query("sample_materialize", f"""WITH x AS (SELECT l_returnflag, count(*) AS n, sum(count(*)) OVER () AS total FROM lineitem GROUP BY 1)
SELECT 'by_flag' AS name, 'stratified' AS strategy, '{{"n": 500, "seed": 42}}' AS params,
 CAST(sum(least(n, greatest(1, floor(500 * n / total)))) AS BIGINT) AS n_rows FROM x""")
def sample_materialize(spark, sf):
    s = sampling.sample_stratified(keyed_lines(spark, sf), F.col("l_returnflag"), 500, "line")
    return sampling.materialize(s, scratch_path(spark, "samples"), "by_flag", "stratified", '{"n": 500, "seed": 42}')


@query("split_ratio", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS pos,
 count(*) OVER () AS n FROM orders),
p AS (SELECT o_orderkey, n, CASE WHEN pos < floor(n * 0.4) THEN 'reference' WHEN pos < 2 * floor(n * 0.4) THEN 'current'
 ELSE 'target' END AS part, CASE WHEN pos < floor(n * 0.4) THEN pos WHEN pos < 2 * floor(n * 0.4) THEN pos - floor(n * 0.4)
 ELSE pos - 2 * floor(n * 0.4) END AS q FROM k)
SELECT o_orderkey, part, CASE WHEN q < floor((CASE part WHEN 'target' THEN n - 2 * floor(n * 0.4) ELSE floor(n * 0.4) END) * 0.8)
 THEN 'train' ELSE 'valid' END AS split FROM p""")
def split_ratio(spark, sf):
    return sampling.split_ratio(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("pairs_with_label", """WITH i AS (SELECT doc_id, 's' || (doc_id % 3) AS split, CAST(doc_id AS VARCHAR) AS stem FROM documents),
l AS (SELECT 's' || (CASE WHEN doc_id % 10 = 0 THEN 9 ELSE doc_id % 3 END) AS split, CAST(doc_id AS VARCHAR) AS stem, quality FROM labels)
SELECT split, stem, doc_id, quality, quality IS NOT NULL AS has_label FROM i LEFT JOIN l USING (split, stem)
UNION ALL SELECT split, stem, NULL, quality, true FROM l WHERE NOT EXISTS
 (SELECT 1 FROM i WHERE i.split = l.split AND i.stem = l.stem)""")
def pairs_with_label(spark, sf):
    k = F.col("doc_id")
    images = table(spark, sf, "documents").select(
        k, F.concat(F.lit("s"), (k % 3).cast("string")).alias("split"), k.cast("string").alias("stem"))
    moved = F.when(k % 10 == 0, 9).otherwise(k % 3)
    labels = table(spark, sf, "labels").select(
        F.concat(F.lit("s"), moved.cast("string")).alias("split"), k.cast("string").alias("stem"), "quality")
    lost = sampling.unmatched_labels(images, labels).select(
        "split", "stem", F.lit(None).cast("bigint").alias("doc_id"), "quality", F.lit(True).alias("has_label"))
    return sampling.pairs_with_label(images, labels).select("split", "stem", "doc_id", "quality", "has_label") \
        .unionByName(lost)
