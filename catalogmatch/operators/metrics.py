"""Ranking quality against a table of expected items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hits(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each gold row with the best rank of its expected item, null when it was not found."""
    found = ranked.select(
        "query_id", F.col("cd_insumo").alias("expected_cd_insumo"), "rank",
    ).groupBy("query_id", "expected_cd_insumo").agg(F.min("rank").alias("rank"))
    return gold.select("query_id", "expected_cd_insumo").join(
        found, ["query_id", "expected_cd_insumo"], "left")


def _labelled(gold: DataFrame, skip_unlabelled: bool) -> DataFrame:
    return gold.where(F.col("expected_cd_insumo").isNotNull()) if skip_unlabelled else gold


def recall_at_k(
    gold: DataFrame, ranked: DataFrame, k: int = 5, skip_unlabelled: bool = False
) -> DataFrame:
    """Share of queries whose expected item stands in the first ``k``; no queries give 0.

    A query without an expected item counts as a miss unless ``skip_unlabelled``.
    """
    hit = F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")
    return _hits(_labelled(gold, skip_unlabelled), ranked).agg(
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("recall"))


def mrr(gold: DataFrame, ranked: DataFrame, skip_unlabelled: bool = False) -> DataFrame:
    """Mean of one over the rank of the expected item, 0 for a miss; no queries give 0."""
    return _hits(_labelled(gold, skip_unlabelled), ranked).agg(
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))
