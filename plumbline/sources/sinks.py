"""Where results are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Decision rows as CSV and as Parquet partitioned by site."""
    decisions.write.mode("append").option("header", True).option("escape", '"').csv(f"{path}/csv")
    decisions.write.mode("append").partitionBy("site_id").parquet(f"{path}/parquet")


def append_timeline(results: DataFrame, path: str) -> None:
    """One line per drift run: (timestamp, overall_score, status, files_added, files_removed)."""
    results.select("timestamp", "overall_score", "status", "files_added", "files_removed") \
        .write.mode("append").option("header", True).option("sep", "\t").csv(path)


def write_plot_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """Report envelopes as JSON lines."""
    envelopes.select(F.col("envelope").alias("value")).write.mode("append").text(path)
