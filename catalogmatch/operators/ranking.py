"""Score candidate pairs, rank them, and filter rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.functions import numbers, scoring, tokens
from catalogmatch.schemas import DEFAULT_THRESHOLD


def sim_tokens(df: DataFrame, a: str, b: str, out: str = "sim") -> DataFrame:
    """Token-set similarity of two text columns; blank or null on either side gives 0."""
    return df.withColumn(out, tokens.token_set_ratio(F.col(a), F.col(b)))


def sim_measures(df: DataFrame, query: str, item: str, out: str = "sim") -> DataFrame:
    """Measure similarity of two folded measure columns."""
    return df.withColumn(out, scoring.measure_similarity(F.col(query), F.col(item)))


def filter_blank(df: DataFrame, col: str, brand: bool = False) -> DataFrame:
    """Rows whose text is blank; with ``brand`` also those that say there is no brand."""
    test = scoring.is_no_brand if brand else scoring.is_blank
    return df.where(test(F.col(col)))


def cosine_scores(df: DataFrame, a: str, b: str, out: str = "score_sbert") -> DataFrame:
    """Cosine of two vector columns, clipped to [0, 1]."""
    return df.withColumn(out, numbers.cosine(F.col(a), F.col(b)))


def with_parts(df: DataFrame, side: str) -> DataFrame:
    """Add ``q_parts`` or ``d_parts`` to rows with the ``q_*`` or ``d_*`` texts (``side`` is q or d).

    A query and an item are in many pairs: where they are fewer than the pairs, make this once for each
    before they meet, and the texts of a pair are not taken apart again.
    """
    texts = [F.col(f"{side}_{name}") for name in ("descricao", "marca", "medida")]
    return df.withColumn(f"{side}_parts", scoring.side_parts(*texts, query=side == "q"))


def attribute_sims(pairs: DataFrame) -> DataFrame:
    """Add ``sim_desc, sim_marca, sim_medida`` to pairs with ``q_*`` and ``d_*`` texts.

    With ``q_parts`` and ``d_parts`` (:func:`with_parts`) these are used in place of the texts.
    """
    if {"q_parts", "d_parts"} <= set(pairs.columns):
        return pairs.withColumns(scoring.compared(F.col("q_parts"), F.col("d_parts")))
    return pairs.withColumns({
        "sim_desc": tokens.token_set_ratio(F.col("q_descricao"), F.col("d_descricao")),
        "sim_marca": scoring.brand_similarity(F.col("q_marca"), F.col("d_marca")),
        "sim_medida": scoring.measure_similarity(F.col("q_medida"), F.col("d_medida")),
    })


def normalize_weights(df: DataFrame, col: str = "weights") -> DataFrame:
    """Scale a struct of weights to a sum of 1; all zero gives the defaults."""
    return df.withColumn(col, scoring.normalized_weights(F.col(col)))


def effective_weights(
    df: DataFrame, weights: Mapping[str, float] | Column | None = None, out: str = "weights"
) -> DataFrame:
    """Add the weights that apply to each query row (``q_descricao, q_marca, q_medida``)."""
    if "q_parts" in df.columns:
        return df.withColumn(out, scoring.weights_without(
            scoring.weights_struct(weights), *[F.col("q_parts").getField(f"no_{n}") for n in ("descricao", "marca", "medida")]))
    return df.withColumn(out, scoring.effective_weights(
        scoring.weights_struct(weights), F.col("q_descricao"), F.col("q_marca"), F.col("q_medida")))


def combine_score(df: DataFrame, weights: str = "weights", out: str = "score") -> DataFrame:
    """Add the score on a 0-100 scale from the four similarities and the weights."""
    return df.withColumn(out, 100.0 * scoring.weighted_score(
        F.col(weights), F.col("score_sbert"), F.col("sim_desc"), F.col("sim_marca"), F.col("sim_medida")))


def filter_threshold(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Keep scores at or above the threshold."""
    return df.where(F.col("score") >= F.lit(float(threshold)))


def rank_matches(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Rank the scores at or above the threshold 1..n per query.

    Ties go to the closer vector, then the smaller id.  A query's group holds its k candidates at
    most, so the window stays small.  The threshold cuts the low end of the order, so it is applied
    after ranking: a filter below the window would have the similarities computed twice.
    """
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.desc("score_sbert"), F.asc("cd_insumo"))
    return filter_threshold(scored.withColumn("rank", F.row_number().over(order)), threshold)


def filter_active(ranked: DataFrame) -> DataFrame:
    """Only active items (status ``AT``); ranks keep their gaps.  A null status is not active."""
    return ranked.where(F.upper("status") == "AT")
