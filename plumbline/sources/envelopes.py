"""Envelope files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_envelopes(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """(source_file, content): one envelope per file, or one per line of larger files."""
    raw = spark.read.text(path, wholetext=one_per_file)
    return raw.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("content"))


def read_envelope_stream(spark: SparkSession, path: str, mode: str = "move", archive: str | None = None,
                         one_per_file: bool = True) -> DataFrame:
    """Each file of a folder once; ``mode`` says what happens to a file when it is done."""
    if mode not in ("move", "delete", "keep"):
        raise ValueError(f"unknown mode {mode!r}")
    reader = spark.readStream.format("text").option("wholetext", one_per_file)
    if mode == "move":
        if not archive:
            raise ValueError("mode 'move' needs an archive folder outside of the watched one")
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif mode == "delete":
        reader = reader.option("cleanSource", "delete")
    return reader.load(path).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("content"))
