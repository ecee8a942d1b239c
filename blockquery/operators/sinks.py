"""Sinks: replaced results, append-only audit, tombstones, caches and two-part exports, as Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_results(results: DataFrame, path: str) -> None:
    """A case's results replace its old ones: dynamic overwrite of its partition."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append-only audit, ledger, vision requests and tombstones."""
    rows.write.mode("append").parquet(path)


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Current state of an append-only table."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def without_tombstones(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Live rows: the last record of a key is not archived."""
    return latest(rows, [key], at).where("status <> 'archived'")


def cache_write(entries: DataFrame, path: str) -> None:
    """Hash-keyed entries, one a key; local fallbacks are not cached but for privacy skips."""
    kept = entries.where("origin <> 'local_fallback' OR reason = 'privacy_skip'")
    kept.dropDuplicates(["key"]).write.mode("append").parquet(path)


def export_two_sheets(values: DataFrame, audit: DataFrame, path: str) -> None:
    """Values in template order and the audit rows, as CSV with headers."""
    values.write.mode("overwrite").option("header", True).csv(f"{path}/values")
    audit.write.mode("overwrite").option("header", True).csv(f"{path}/audit")


def truncate(spark, schema, path: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
