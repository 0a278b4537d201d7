"""Statistics over human feedback (flat stored columns).

Every statistic is a partial aggregation before its shuffle, so a query or session with a third
of all votes costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.functions.numbers import round_one_decimal
from catalogmatch.functions.text import strip
from catalogmatch.schemas import GOAL_QUERIES, GOAL_VALIDATIONS, GOAL_VALIDATIONS_PER_QUERY

KEY = ["key_descricao", "key_marca", "key_medida"]


def query_key(feedback: DataFrame) -> DataFrame:
    """Add the trimmed, upper-cased query fields; null becomes ``''``.

    Three columns instead of one joined text: a bar inside a field then cannot merge two queries.
    """
    def key(name: str):
        return F.upper(strip(F.coalesce(name, F.lit(""))))

    return feedback.withColumns({
        "key_descricao": key("user_descricao"),
        "key_marca": key("user_marca"),
        "key_medida": key("user_medida"),
    })


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Total, approved and rejected votes.  A vote without a label counts as rejected."""
    counted = feedback.agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("approved"))
    return counted.withColumn("rejected", F.col("total") - F.col("approved"))


def feedback_query_counts(feedback: DataFrame) -> DataFrame:
    """Votes per query."""
    return query_key(feedback).groupBy(KEY).agg(F.count("*").alias("validations"))


def feedback_queries_3plus(feedback: DataFrame) -> DataFrame:
    """Number of different queries, and of those with three votes or more."""
    return feedback_query_counts(feedback).agg(
        F.count("*").alias("unique_queries"),
        F.count_if(F.col("validations") >= GOAL_VALIDATIONS_PER_QUERY).alias("queries_3plus"),
    )


def feedback_top_queries(feedback: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` queries with most votes under a readable label; ties in key order."""
    # ---- fixed values: label texts ----
    no_description, brand, measure, separator = "(sem descrição)", "marca=", "medida=", " · "
    # ---- end of fixed values ----
    top = feedback_query_counts(feedback).orderBy(F.desc("validations"), *KEY).limit(n)
    return top.select(
        F.concat_ws(
            separator,
            F.when(F.col("key_descricao") == "", no_description).otherwise(F.col("key_descricao")),
            F.when(F.col("key_marca") != "", F.concat(F.lit(brand), "key_marca")),
            F.when(F.col("key_medida") != "", F.concat(F.lit(measure), "key_medida")),
        ).alias("query"),
        "validations",
    )


def feedback_rank_dist(feedback: DataFrame) -> DataFrame:
    """Votes per rank in rank order; votes without a rank are not shown."""
    return (
        feedback.where(F.col("rank_posicao").isNotNull())
        .groupBy(F.col("rank_posicao").alias("rank")).agg(F.count("*").alias("validations"))
        .orderBy("rank")
    )


def _shares(counts: DataFrame) -> DataFrame:
    share = F.when(F.col("total") > 0, round_one_decimal(100 * F.col("approved") / F.col("total")))
    approved = counts.withColumn("approved_pct", F.coalesce(share, F.lit(0.0)))
    rejected = F.when(F.col("total") > 0, round_one_decimal(100.0 - F.col("approved_pct")))
    return approved.withColumns({
        "rejected_pct": F.coalesce(rejected, F.lit(0.0)),
        "imbalanced": (F.col("total") >= 50) & (F.abs(F.col("approved_pct") - 50) > 25),
    })


def feedback_balance(feedback: DataFrame) -> DataFrame:
    """Approved and rejected share in percent; imbalanced from 50 votes and 25 points on."""
    return _shares(feedback_counts(feedback))


def feedback_readiness(feedback: DataFrame) -> DataFrame:
    """One row with counts, shares, the gaps to the goals and the progress in whole percent.

    One aggregation per query key, then one over the keys: the votes are read once.
    """
    per_query = query_key(feedback).groupBy(KEY).agg(
        F.count("*").alias("votes"), F.count_if(F.col("label") == 1).alias("yes"))
    totals = per_query.agg(
        F.coalesce(F.sum("votes"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("yes"), F.lit(0)).alias("approved"),
        F.count("*").alias("unique_queries"),
        F.count_if(F.col("votes") >= GOAL_VALIDATIONS_PER_QUERY).alias("queries_3plus"),
    ).withColumn("rejected", F.col("total") - F.col("approved"))

    def progress(name: str, goal: int):
        return F.least(F.lit(100), F.floor(100 * F.col(name) / goal)).cast("bigint")

    return _shares(totals).withColumns({
        "ready": (F.col("total") >= GOAL_VALIDATIONS) & (F.col("unique_queries") >= GOAL_QUERIES),
        "missing_validations": F.greatest(F.lit(0), GOAL_VALIDATIONS - F.col("total")).cast("bigint"),
        "missing_queries": F.greatest(F.lit(0), GOAL_QUERIES - F.col("unique_queries")).cast("bigint"),
        "validations_progress": progress("total", GOAL_VALIDATIONS),
        "queries_progress": progress("unique_queries", GOAL_QUERIES),
    })
