"""Annotated items: listing, edits, label formats and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.frames import with_scalars


def filter_items(items: DataFrame, split: str | None = None, cls: str | int | None = None,
                 names: Sequence[str] = ()) -> DataFrame:
    """Items of a split and a class, the class given by name or by index into ``names``."""
    if split is not None:
        items = items.where(F.col("split") == split)
    if cls is not None:
        wanted = [str(cls)]
        if str(cls).isdigit() and int(cls) < len(names):
            wanted.append(names[int(cls)])
        items = items.where(F.arrays_overlap("classes", F.array(*[F.lit(w) for w in wanted])))
    return items


def page(items: DataFrame, order: str = "path", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in path order with the total count of matching items."""
    total = items.agg(F.count("*").alias("total"))
    return with_scalars(items.orderBy(order).offset(offset).limit(limit), total)


def preview(items: DataFrame, item_id: str) -> DataFrame:
    return items.where(F.col("id") == item_id)


def relabel(items: DataFrame, ids: DataFrame, new_label: str, names: Sequence[str]) -> DataFrame:
    """Give every label of the chosen items the new class; an unknown class name is an error."""
    if new_label.isdigit():
        new_label = names[int(new_label)] if int(new_label) < len(names) else f"class_{new_label}"
    elif new_label not in names:
        raise ValueError(f"unknown class: {new_label}")
    chosen = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return (items.join(chosen, "id", "left")
            .withColumn("classes", F.when(F.col("_hit"), F.transform("classes", lambda c: F.lit(new_label)))
                        .otherwise(F.col("classes")))
            .withColumn("relabeled", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def move(items: DataFrame, ids: DataFrame, target: str) -> DataFrame:
    """Put the chosen items in a split; ``moved`` is false where they already were in it."""
    chosen = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    moved = F.coalesce(F.col("_hit") & ~F.col("split").eqNullSafe(target), F.lit(False))
    return (items.join(chosen, "id", "left").withColumn("moved", moved)
            .withColumn("split", F.when(F.col("moved"), F.lit(target)).otherwise(F.col("split"))).drop("_hit"))


def unknown_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(items.select("id"), "id", "left_anti")


def add(items: DataFrame, new: DataFrame, target: str) -> DataFrame:
    return items.unionByName(new.withColumn("split", F.lit(target)))


def remove(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id"), "id", "left_anti")


# ---- boxes -----------------------------------------------------------------

def boxes_to_coco(boxes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Normalised centre boxes to pixel corner boxes with area and a running id.

    Boxes of pictures without a known size are dropped. The id counts over the whole
    table, so it comes from range chunks and not from one global window.
    """
    from ..plans.ordered import numbered
    known = boxes.where((F.col("width") > 0) & (F.col("height") > 0))
    w, h = F.col("w") * F.col("width"), F.col("h") * F.col("height")
    out = known.select(
        *order, "class_id",
        ((F.col("cx") - F.col("w") / 2) * F.col("width")).alias("x"),
        ((F.col("cy") - F.col("h") / 2) * F.col("height")).alias("y"),
        w.alias("box_w"), h.alias("box_h"), (w * h).alias("area"))
    return numbered(out, [], order, "annotation_id").withColumn(
        "annotation_id", F.col("annotation_id") + 1).drop("annotation_id_total")


def boxes_to_voc(boxes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Normalised centre boxes to integer pixel corners."""
    def corner(c: str, size: str, full: str, sign: int) -> Column:
        return ((F.col(c) + sign * F.col(size) / 2) * F.col(full)).cast("int")
    known = boxes.where((F.col("width") > 0) & (F.col("height") > 0))
    return known.select(*keep, corner("cx", "w", "width", -1).alias("xmin"), corner("cy", "h", "height", -1).alias("ymin"),
                        corner("cx", "w", "width", 1).alias("xmax"), corner("cy", "h", "height", 1).alias("ymax"))


EXPORT_LAYOUT = {"yolo": ("images", "labels"), "coco": ("images", "annotations"), "voc": ("JPEGImages", "Annotations")}


def export_splits(items: DataFrame, layout: str, splits: Sequence[str]) -> DataFrame:
    """Items of the chosen splits with their target path in the layout; no split means train."""
    if layout not in EXPORT_LAYOUT:
        raise ValueError(f"unknown layout {layout!r}")
    pictures, labels = EXPORT_LAYOUT[layout]
    split = F.coalesce("split", F.lit("train"))
    suffix = {"yolo": ".txt", "voc": ".xml", "coco": ".json"}[layout]
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    if layout == "voc":
        picture, label = F.concat(F.lit(f"{pictures}/"), "filename"), F.concat(F.lit(f"{labels}/"), stem, F.lit(suffix))
    elif layout == "yolo":
        picture = F.concat(split, F.lit(f"/{pictures}/"), "filename")
        label = F.concat(split, F.lit(f"/{labels}/"), stem, F.lit(suffix))
    else:
        picture = F.concat(F.lit(f"{pictures}/"), split, F.lit("/"), "filename")
        label = F.concat(F.lit(f"{labels}/instances_"), split, F.lit(suffix))
    return (items.withColumn("split", split).where(F.col("split").isin(list(splits)))
            .withColumn("target_path", picture).withColumn("label_target", label))


def write_export(exported: DataFrame, path: str) -> None:
    exported.write.mode("overwrite").partitionBy("split").parquet(path)


# ---- label files -----------------------------------------------------------

def write_yolo(boxes: DataFrame, path: str) -> None:
    """Label lines ``class cx cy w h`` per split; (split, class_id, cx, cy, w, h)."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("class_id", "cx", "cy", "w", "h")])
    boxes.select("split", line.alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_coco(boxes: DataFrame, path: str) -> None:
    """Annotations as JSON lines per split, never one document in one task; the output of ``boxes_to_coco`` with split and item."""
    boxes.select("split", F.col("annotation_id").alias("id"), F.col("item").alias("image_id"), F.col("class_id").alias("category_id"),
                 F.array("x", "y", "box_w", "box_h").alias("bbox"), "area", F.lit(0).alias("iscrowd")) \
        .write.mode("overwrite").partitionBy("split").json(path)


def write_voc(boxes: DataFrame, names: DataFrame, path: str) -> None:
    """One XML record per picture with all its objects; the output of ``boxes_to_voc`` with split, filename, width and height.

    A picture's boxes are collected, of which there are few; a class without a name is ``class_<i>``.
    """
    name = F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    entry = F.struct(name.alias("name"), F.struct("xmin", "ymin", "xmax", "ymax").alias("bndbox"))
    pictures = boxes.join(names, "class_id", "left").groupBy("split", "filename", "width", "height").agg(F.sort_array(F.collect_list(entry)).alias("object"))
    pictures.select("split", F.lit("images").alias("folder"), "filename", F.struct("width", "height", F.lit(3).alias("depth")).alias("size"), "object") \
        .write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "annotation").partitionBy("split").save(path)
