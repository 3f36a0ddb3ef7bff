"""Table sinks (S2, S3): full-refresh writes that are idempotent.

``DROP TABLE IF EXISTS`` + ``CREATE`` + ``INSERT … SELECT`` becomes a pure DataFrame written
with ``mode("overwrite")``.  A Parquet overwrite deletes the old files first, so a job that fails
midway leaves the table incomplete until the build is run again; a build that must never be seen
half-written goes to a new folder (:func:`orgpulse.plans.marts.write_marts` without ``out_dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_and_read(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write a table and continue from the written copy (cuts lineage, survives lost executors)."""
    write_table(df, path)
    return spark.read.parquet(path)
