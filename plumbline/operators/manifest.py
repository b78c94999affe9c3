"""File lists: kinds, junk, totals, and the layout of a dataset from its paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names that are never data, and the extensions of each kind.
JUNK_FOLDERS = ["__MACOSX", ".git", ".svn", "__pycache__", ".idea"]
JUNK_FILES = [".DS_Store", "Thumbs.db", ".gitkeep", ".gitignore"]
JUNK_PREFIX = "._"
KINDS = {
    "image": ["png", "jpg", "jpeg", "bmp", "gif"],
    "text": ["txt", "md", "jsonl"],
    "csv": ["csv", "tsv"],
    "video": ["mp4", "mov", "avi", "mkv"],
    "audio": ["wav", "mp3", "flac", "ogg", "m4a"],
    "json": ["json"],
    "xml": ["xml"],
}


def is_junk(path: Column) -> Column:
    """True if the file or any folder on the way to it is junk."""
    names = [*JUNK_FOLDERS, *JUNK_FILES]
    return F.exists(F.split(path, "/"), lambda p: p.isin(names) | p.startswith(JUNK_PREFIX))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    out = F.when(F.lit(False), F.lit(""))
    for kind, exts in KINDS.items():
        out = out.when(ext.isin(exts), F.lit(kind))
    return out.otherwise(F.lit("other"))


def manifest_stats(files: DataFrame) -> DataFrame:
    """(dataset, path, size): files per kind, bytes and number of top-level folders of each dataset."""
    clean = files.where(~is_junk(F.col("path"))).withColumn("kind", file_kind(F.col("path")))
    return clean.groupBy("dataset").agg(
        F.count("*").alias("total_files"), F.sum("size").alias("total_size"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}_files") for k in [*KINDS, "other"]],
        F.count_distinct(_top_folder()).alias("n_folders"))


def _top_folder() -> Column:
    return F.when(F.contains(F.col("path"), F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1)))


def top_folders(files: DataFrame) -> DataFrame:
    """(dataset, folder, n_files): one row per top-level folder."""
    inside = files.where(~is_junk(F.col("path"))).withColumn("folder", _top_folder()).where("folder IS NOT NULL")
    return inside.groupBy("dataset", "folder").agg(F.count("*").alias("n_files"))


def detect_format(files: DataFrame) -> DataFrame:
    """(dataset, path) -> layout of each dataset, judged by its paths alone."""
    p = F.col("path")
    kind = file_kind(p)

    def any_of(cond: Column) -> Column:
        return F.bool_or(cond)

    flags = files.where(~is_junk(p)).groupBy("dataset").agg(
        any_of(p == "data.yaml").alias("yaml"),
        *[any_of(p.startswith(f"{s}/")).alias(s) for s in ("train", "valid", "test")],
        *[any_of(p.startswith(f"{s}/images/")).alias(f"{s}_i") for s in ("train", "valid", "test")],
        *[any_of(p.startswith(f"{s}/labels/")).alias(f"{s}_l") for s in ("train", "valid", "test")],
        any_of(p.startswith("images/")).alias("images"), any_of(p.startswith("labels/")).alias("labels"),
        any_of(p.rlike(r"^Annotations/[^/]+\.xml$")).alias("voc_xml"),
        any_of(p.rlike(r"^JPEGImages/[^/]+\.jpg$")).alias("voc_jpg"),
        any_of(p.rlike(r"^annotations/[^/]+\.json$")).alias("coco_json"),
        any_of(kind == "image").alias("any_image"), any_of(kind == "csv").alias("any_csv"),
        any_of(kind == "text").alias("any_text"))

    def complete(s: str) -> Column:
        return ~F.col(s) | (F.col(f"{s}_i") & F.col(f"{s}_l"))

    has_split = F.col("train") | F.col("valid") | F.col("test")
    return flags.select("dataset", F.when(
        F.col("yaml") & has_split & complete("train") & complete("valid") & complete("test"), "roboflow")
        .when(F.col("images") & F.col("labels"), "yolo")
        .when(F.col("voc_xml") & F.col("voc_jpg"), "voc")
        .when(F.col("images") & F.col("coco_json"), "coco")
        .when(F.col("any_csv"), "tabular_bundle")
        .when(F.col("any_text"), "text_bundle")
        .when(F.col("any_image"), "image_bundle")
        .otherwise("unknown").alias("format"))
