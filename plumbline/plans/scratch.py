"""Where intermediate data goes: the shared folder named by the session.

A cluster names the folder in ``spark.checkpoint.dir``. Where that is unset, the folder
lies under the warehouse, which the driver and the executors share as well. Each
application has a folder of its own there, which goes when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_KNOWN: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_root(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``, or else under the warehouse."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    above = configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    root = f"{above.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"
    if root not in _KNOWN:
        fs, path = _file_system(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _KNOWN.add(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read again instead of made again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def bytes_of(table: DataFrame) -> int:
    """Size of a table of ``written`` on disk."""
    fs, where = _file_system(table.sparkSession, table.scratch_path)
    return fs.getContentSummary(where).getLength()


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for table in tables:
        fs, where = _file_system(table.sparkSession, table.scratch_path)
        fs.delete(where, True)


def pieces(df: DataFrame) -> int:
    """As many partitions as any shuffle has: a number that is given stays, where Spark would merge by bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows and cuts the lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)
