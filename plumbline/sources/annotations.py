"""Annotations: label lines, XML objects, JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def parse_label_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``cls cx cy w h`` lines; the class is the integer part of the first number, bad lines are dropped."""
    parts = F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ")

    def number(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("double")

    cls = number(0)
    # cut off the fraction like int(float(x)); not-a-number is no class
    parsed = lines.withColumn("class_id", F.when(~F.isnan(cls) & (F.abs(cls) < 2 ** 31), cls.cast("int")))
    for i, c in enumerate(("cx", "cy", "w", "h")):
        parsed = parsed.withColumn(c, number(i + 1))
    return parsed.where("class_id IS NOT NULL")


def name_classes(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(class_id, name) joined; a class without a name is ``class_<i>``."""
    return labels.join(names, "class_id", "left").withColumn(
        "class", F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))).drop("name")


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path)
    return parse_label_lines(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))


_OBJECT = T.StructType([T.StructField("name", T.StringType()), T.StructField("bndbox", T.StructType([
    T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]))])


def read_voc_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, class) per object element of annotation XML files."""
    raw = spark.read.format("xml").option("rowTag", "object").schema(_OBJECT).load(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.trim("name").alias("class"), "bndbox.*").where("class <> ''")


_COCO = T.StructType([
    T.StructField("categories", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType()))])))])


def coco_annotations(documents: DataFrame, column: str = "content", unknown: str = "unknown") -> DataFrame:
    """(document, image, class) per annotation; ``unknown="id"`` keeps the text of an id without category.

    The category list belongs to its document and is looked up in place.
    """
    d = documents.withColumn("_d", F.from_json(column, _COCO))
    names = F.map_from_entries(F.transform("_d.categories", lambda c: F.struct(c["id"], c["name"])))
    rows = d.select(*[c for c in documents.columns if c != column], names.alias("_names"), F.explode("_d.annotations").alias("a"))
    fallback = F.col("a.category_id").cast("string") if unknown == "id" else F.lit("unknown")
    return rows.select(*[c for c in documents.columns if c != column], F.col("a.id").alias("annotation_id"),
                       F.col("a.image_id").alias("image_id"),
                       F.coalesce(F.try_element_at("_names", F.col("a.category_id")), fallback).alias("class"))
