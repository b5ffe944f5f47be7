"""Raw table access.

Tables are Parquet files or folders; reading is lazy, so column pruning and filter
pushdown reach the scan through whatever the operator selects.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _status(spark: SparkSession, path: str):
    """The status of a file or folder in the store that Spark reads, or None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(p) if files.exists(p) else None


def is_file(spark: SparkSession, path: str) -> bool:
    status = _status(spark, path)
    return status is not None and status.isFile()


def table_path(sf_dir: str, name: str, spark: SparkSession | None = None) -> str:
    """Path of a table: ``<dir>/<name>.parquet`` (file or folder) or ``<dir>/<name>``.  With a
    session the store is asked, which may be one that only Spark can open."""
    base = sf_dir.rstrip("/")
    candidate = f"{base}/{name}.parquet"
    there = os.path.exists(candidate) if spark is None else _status(spark, candidate) is not None
    return candidate if there else f"{base}/{name}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name, spark))
