"""Folders of versions below a path: what is there, and which are complete.

All listing goes through Spark's file systems, so a path may lie in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_PREFIX = "version="


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return bool(system.exists(where))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where there is no folder."""
    system, where = _at(spark, path)
    return [status.getPath().getName() for status in system.listStatus(where)] if system.exists(where) else []


def folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/{_PREFIX}{version:08d}"


def every(spark: SparkSession, path: str) -> list[int]:
    """Versions below a path, ascending, complete or not."""
    return sorted(int(name.removeprefix(_PREFIX)) for name in children(spark, path) if name.startswith(_PREFIX))


def complete(spark: SparkSession, path: str) -> list[int]:
    """Versions whose job has ended, ascending."""
    return [v for v in every(spark, path) if exists(spark, f"{folder(path, v)}/_SUCCESS")]


def drop(spark: SparkSession, path: str, old: list[int]) -> None:
    for version in old:
        system, where = _at(spark, folder(path, version))
        system.delete(where, True)


def table_folder(spark: SparkSession, table: str) -> str:
    """Where a table's files are."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    return rows[0].data_type.rstrip("/")
