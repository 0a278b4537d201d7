"""Session helpers: the shared scratch folder and the size check in front of broadcasts."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path below the one the cluster shares.

    That is ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``.  Only a session
    that runs on one machine may go without and gets a temporary folder; on a cluster executors
    would each write to a disk of their own, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = _local_dir(spark.sparkContext.master)
    return f"{base.rstrip('/')}/catalogmatch-{label}-{uuid.uuid4().hex}"


def _local_dir(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="run-")


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads at most one row more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup table for broadcast only after counting that it is small.

    A larger one is returned as it is, so Spark plans a shuffle join and AQE splits skewed keys.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def wide_tasks(spark: SparkSession) -> int:
    """Number of tasks for rows that are few in bytes but expensive to compute.

    AQE sizes partitions by bytes and would leave such work to a handful of tasks; an explicit
    number is kept.
    """
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly over ``wide_tasks`` tasks, by a hash of all their columns.

    A table of short rows is a few megabytes for a million of them, so Spark reads it in a task or two
    and every expression on it would run there.
    """
    return df.repartition(wide_tasks(df.sparkSession), F.xxhash64(*df.columns))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where it is not installed on the executors and was not given to ``--py-files``.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="run-"), "catalogmatch"), "zip",
        os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
