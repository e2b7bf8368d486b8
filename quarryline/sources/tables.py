"""Readers for the Parquet tables of a data folder, and the canonical form of rows that are delivered repeatedly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters of the query reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_files(files: DataFrame, *columns: str | Column) -> DataFrame:
    """One row per ``file_id``: the last delivery (ties by the greatest values), with the asked columns only.

    Columns may be expressions: whatever is asked of a text is told in the scan, so that the text itself is not shuffled.
    """
    rows = files.select("file_id", "arrived_at", *columns)
    names = rows.columns[2:]
    return rows.groupBy("file_id").agg(F.max_by(F.struct(*names), F.struct("arrived_at", *names)).alias("_row")).select("file_id", "_row.*")


def last_deliveries(files: DataFrame) -> DataFrame:
    """(file_id, arrived_at) of each file's last delivery, on narrow rows."""
    return files.groupBy("file_id").agg(F.max("arrived_at").alias("arrived_at"))
