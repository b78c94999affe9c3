"""Results kept as Parquet by data hash and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class AnalysisCache:
    """Results under ``path``: one folder per (data_hash, cache_type), pruned on load.

    One hash may serve many snapshots; the index is a table of (data_hash, cache_type,
    snapshot_id) appended on every save.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, data_hash: str, cache_type: str) -> str:
        return f"{self.path}/data/data_hash={data_hash}/cache_type={cache_type}"

    def _index(self) -> DataFrame:
        schema = "data_hash string, cache_type string, snapshot_id string"
        if not self._is_there(f"{self.path}/index"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/index")

    def _is_there(self, folder: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(hadoop)

    def exists(self, data_hash: str, cache_type: str) -> bool:
        return self._is_there(self._folder(data_hash, cache_type) + "/_SUCCESS")

    def save(self, df: DataFrame, data_hash: str, cache_type: str, snapshot_id: str) -> None:
        df.write.mode("overwrite").parquet(self._folder(data_hash, cache_type))
        self._register(data_hash, cache_type, snapshot_id)

    def _register(self, data_hash: str, cache_type: str, snapshot_id: str) -> None:
        row = self.spark.range(1).select(F.lit(data_hash).alias("data_hash"), F.lit(cache_type).alias("cache_type"),
                                         F.lit(snapshot_id).alias("snapshot_id"))
        row.write.mode("append").parquet(f"{self.path}/index")

    def load(self, data_hash: str, cache_type: str) -> DataFrame | None:
        if not self.exists(data_hash, cache_type):
            return None
        return self.spark.read.parquet(self._folder(data_hash, cache_type))

    def link(self, data_hash: str, cache_type: str, snapshot_id: str) -> None:
        """Let another snapshot with the same data use the result."""
        self._register(data_hash, cache_type, snapshot_id)

    def copy(self, data_hash: str, new_hash: str, snapshot_id: str) -> int:
        """Copy all results of a hash to another one; returns how many kinds."""
        kinds = [r[0] for r in self._index().where(F.col("data_hash") == data_hash).select("cache_type").distinct().collect()]
        for kind in kinds:
            self.save(self.load(data_hash, kind), new_hash, kind, snapshot_id)
        return len(kinds)

    def list(self) -> DataFrame:
        """(data_hash, cache_type, snapshot_id): which snapshot uses which result."""
        return self._index().distinct()

    def snapshots_of(self, data_hash: str) -> DataFrame:
        return self._index().where(F.col("data_hash") == data_hash).select("snapshot_id").distinct()
