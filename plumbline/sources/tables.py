"""Readers for tables, texts and declared datasets."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

# Names taken for the row id where none is declared, in this order.
ID_NAMES = ["id", "ID", "index", "INDEX", "idx"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with header; types are inferred where no schema is given."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_union(spark: SparkSession, paths: Sequence[str], text_column: str, id_column: str | None = None,
                   multiline: bool = False) -> DataFrame:
    """All CSV files with the text column, by name, with ``_source_file`` and ``_id``.

    The id is the declared column, else the first of the usual names, else
    ``<file>_<row>``. Files with the same header are read together, so there is one reader
    per different header and not per file. Rows are numbered per piece of a file that one
    task reads, plus the rows of the pieces before it, so a file of any size is fine.
    ``multiline`` is for texts with line breaks: such a file is read by one task.
    """
    out = None
    for header, files in headers(spark, paths).items():
        if text_column not in header:
            continue
        df = (spark.read.schema(", ".join(f"`{c}` string" for c in header)).option("header", True).option("multiLine", multiline)
              .option("escape", '"').csv(files))
        df = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_order"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file has the column {text_column!r}")
    columns = [c for c in out.columns if c not in ("_path", "_start", "_order")]
    stem = F.regexp_extract("_path", r"([^/]+?)(\.[^./]*)?$", 1)
    out = out.withColumn("_source_file", F.regexp_extract("_path", r"([^/]+)$", 1))
    declared = [id_column] if id_column and id_column in columns else []
    names = declared or [c for c in ID_NAMES if c in columns]
    if not names:
        pieces = out.groupBy("_path", "_start").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        out = out.join(pieces.select("_path", "_start", before.alias("_before")), ["_path", "_start"])
        row = F.row_number().over(Window.partitionBy("_path", "_start").orderBy("_order")) - 1 + F.col("_before")
        return out.withColumn("_id", F.concat(stem, F.lit("_"), row.cast("string"))).select(*columns, "_source_file", "_id")
    row_id = F.coalesce(*[F.col(c).cast("string") for c in names])
    return out.withColumn("_id", row_id).select(*columns, "_source_file", "_id")


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The different headers of CSV files (folders: of their files) and the files that have them, from one job.

    A file's header is its first line, so each file gives one row and the driver the names.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                                F.monotonically_increasing_id().alias("row"), "value").where("at = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for row in found:
        names = tuple(next(csv.reader([row["header"]]), []))
        out.setdefault(names, []).extend(row["files"])
    return out


def rename_single_file(spark: SparkSession, folder: str, path: str) -> None:
    """Move the only file that Spark wrote into a folder to a path of its own."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")]
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(path))


def text_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line number, line) of a text column."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files of a folder with the file they come from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def json_or_text(df: DataFrame, column: str) -> DataFrame:
    """Adds ``parsed`` (variant, null where it is no JSON) and ``kind`` json or text."""
    parsed = F.try_parse_json(column)
    return df.withColumn("parsed", parsed).withColumn("kind", F.when(F.col("parsed").isNull(), "text").otherwise("json"))


# The keys each modality must declare.
REQUIRED = {"timeseries": ["csv_file", "timestamp_column"], "text": ["text_column"], "audio": ["formats"], "image": ["formats"]}


class DatasetError(ValueError):
    """A declared dataset does not fit."""


@dataclass
class DatasetSpec:
    """What a dataset declares about its table."""

    modality: str
    csv_file: str | None = None
    timestamp_column: str | None = None
    numeric_columns: list[str] = field(default_factory=list)
    categorical_columns: list[str] = field(default_factory=list)
    text_column: str | None = None
    id_column: str | None = None
    language: str = "english"
    formats: list[str] = field(default_factory=list)


def parse_spec(config: dict, modality: str) -> DatasetSpec:
    if config.get("modality") != modality:
        raise DatasetError(f"expected modality {modality!r}, got {config.get('modality')!r}")
    missing = [k for k in REQUIRED.get(modality, []) if not config.get(k)]
    if missing:
        raise DatasetError(f"missing keys: {missing}")
    known = {k: v for k, v in config.items() if k in DatasetSpec.__dataclass_fields__}
    return DatasetSpec(**known)


def bind(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The declared columns of a table."""
    names = [spec.id_column, spec.timestamp_column, spec.text_column, *spec.numeric_columns, *spec.categorical_columns]
    columns = [n for n in names if n]
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise DatasetError(f"columns not in the table: {absent}")
    return df.select(*columns)


# ---- readers by address ----------------------------------------------------

class NoAdapter(ValueError):
    code = "no_adapter_for_scheme"


# Schemes of the file systems Spark reads by itself.
SCHEMES = ["file", "hdfs", "s3a", "abfss", "gs"]
FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "json", "txt": "text"}


def read_uri(spark: SparkSession, uri: str, format: str | None = None, **options) -> DataFrame:
    """Read an address in place; the format follows from the file name where it is not given."""
    scheme, sep, _ = uri.partition("://")
    if not sep or scheme not in SCHEMES:
        raise NoAdapter(f"no_adapter_for_scheme: {scheme if sep else uri!r}")
    name = uri.rstrip("/").rsplit("/", 1)[-1]
    fmt = format or FORMATS.get(name.rsplit(".", 1)[-1].lower(), "parquet")
    if fmt == "csv":
        options = {"header": True, **options}
    return spark.read.format(fmt).options(**options).load(uri)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime, extension) of the files below a path; their content is not read."""
    from ..operators.manifest import extension, is_junk
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    return files.where(~is_junk(F.col("path"))).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), extension(F.col("path")).alias("extension"))
