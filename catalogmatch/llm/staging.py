"""Tables written between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalogmatch.session import shared_dir

LAST = 2**63 - 1  # stands for a missing doc_id wherever ids are ordered: after all others


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it again.

    Cuts lineage, so a lost executor costs a re-read.  The rows come back without a partitioning, so
    a join with them shuffles both sides and AQE may split a hot key.  The returned frame reads the
    files lazily: the folder is the application's to delete once the results are written.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
