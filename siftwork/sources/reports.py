"""Tool reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, tool, payload)`` of report files named ``.../<run_id>/<tool>.<ext>``."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    return whole.select(
        F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("run_id"),
        F.regexp_extract(name, r"/([^/.]+)(?:\.[^/]*)?$", 1).alias("tool"),
        F.col("value").alias("payload"),
    )
