"""Attribute similarities, weights and the final score as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogmatch.functions.measures import parse_measure
from catalogmatch.functions.text import let, strip
from catalogmatch.functions.tokens import set_ratio, token_set_ratio, word_set
from catalogmatch.schemas import DEFAULT_WEIGHTS, NO_BRAND_TEXTS, WEIGHT_FIELDS


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def is_no_brand(text: Column) -> Column:
    """Blank, or one of the texts that say the brand is unknown."""
    return F.coalesce(F.lower(strip(text)).isin(*NO_BRAND_TEXTS), F.lit(True))


def measure_similarity(query: Column, item: Column) -> Column:
    """Closeness of two measures in [0, 1].

    A blank query costs nothing (1.0), a blank item costs everything (0.0); the query is looked at
    first.  Two numbers with equal or missing units: one minus the relative error, whose divisor
    is at least 1.  Two numbers with different units: 0.  Otherwise the token similarity.
    """
    return _measures_compared(
        parse_measure(query), parse_measure(item), is_blank(query), is_blank(item),
        lambda texts: token_set_ratio(F.when(texts, query), item))


def _measures_compared(q: Column, d: Column, q_blank: Column, d_blank: Column, words: Callable[[Column], Column]) -> Column:
    """:func:`measure_similarity` of parsed measures; ``words`` compares texts where its condition holds."""
    q_value, d_value = q.getField("value"), d.getField("value")
    q_unit, d_unit = q.getField("unit"), d.getField("unit")
    same_unit = (q_unit == d_unit) | (q_unit == "") | (d_unit == "")
    larger = F.greatest(F.abs(q_value), F.abs(d_value), F.lit(1.0))
    closeness = F.greatest(F.lit(0.0), 1.0 - F.abs(q_value - d_value) / larger)
    numeric = q_value.isNotNull() & d_value.isNotNull()
    return (
        F.when(q_blank, 1.0)
        .when(d_blank, 0.0)
        .when(numeric & same_unit, closeness)
        .when(numeric, 0.0)
        .otherwise(words(~numeric))  # keeps pairs of numbers out of the text comparison
    )


def brand_similarity(query: Column, item: Column) -> Column:
    """Token similarity with an unknown brand on the query side treated as blank."""
    return token_set_ratio(F.when(~is_no_brand(query), query), item)


def side_parts(descricao: Column, marca: Column, medida: Column, query: bool) -> Column:
    """What the comparison needs of one side: word sets, the parsed measure, and which fields are absent.

    Made once for a query or an item, it saves doing the same for each of its pairs.  An unknown brand
    has no words on the query side.
    """
    brand = F.when(~is_no_brand(marca), marca) if query else marca
    return F.struct(
        word_set(descricao).alias("descricao"), word_set(brand).alias("marca"), word_set(medida).alias("words"), parse_measure(medida).alias("medida"),
        is_blank(descricao).alias("no_descricao"), is_no_brand(marca).alias("no_marca"), is_blank(medida).alias("no_medida"))


def compared(q: Column, d: Column) -> dict[str, Column]:
    """The three similarities of a query and an item by their :func:`side_parts`."""
    none = F.array().cast("array<string>")
    medida = _measures_compared(
        q.getField("medida"), d.getField("medida"), q.getField("no_medida"), d.getField("no_medida"),
        lambda texts: set_ratio(F.when(texts, q.getField("words")).otherwise(none), d.getField("words")))
    return {
        "sim_desc": set_ratio(q.getField("descricao"), d.getField("descricao")),
        "sim_marca": set_ratio(q.getField("marca"), d.getField("marca")),
        "sim_medida": medida,
    }


def weights_struct(weights: Mapping[str, float] | Column | None = None) -> Column:
    """Weights as a struct column; none or an empty mapping means the defaults."""
    if isinstance(weights, Column):
        return weights
    chosen = weights or DEFAULT_WEIGHTS
    return F.struct(*[F.lit(float(chosen[name])).alias(name) for name in WEIGHT_FIELDS])


_SUM = "(" + " + ".join(f"w.{name}" for name in WEIGHT_FIELDS) + ")"
_SHARES = "named_struct(" + ", ".join(f"'{name}', w.{name} / {_SUM}" for name in WEIGHT_FIELDS) + ")"
_DEFAULTS = "named_struct(" + ", ".join(f"'{name}', {v}D" for name, v in DEFAULT_WEIGHTS.items()) + ")"


def normalized_weights(weights: Column) -> Column:
    """Scale to a sum of 1; a sum of zero or less falls back to the defaults."""
    return let(weights, f"w -> if({_SUM} <= 0, {_DEFAULTS}, {_SHARES})")


def effective_weights(weights: Column, descricao: Column, marca: Column, medida: Column) -> Column:
    """Zero the weights of fields absent from the query and scale the rest to a sum of 1.

    The vector weight is never zeroed.  When nothing is left the given weights come back as they are.
    """
    return weights_without(weights, is_blank(descricao), is_no_brand(marca), is_blank(medida))


def weights_without(weights: Column, no_descricao: Column, no_marca: Column, no_medida: Column) -> Column:
    """:func:`effective_weights` where it is known which fields are absent."""
    absent = {"desc": no_descricao, "marca": no_marca, "medida": no_medida}
    kept = F.struct(*[
        (F.when(absent[n], 0.0).otherwise(weights.getField(n)) if n in absent else weights.getField(n)).alias(n)
        for n in WEIGHT_FIELDS
    ])
    return F.coalesce(let(kept, f"w -> if({_SUM} <= 0, null, {_SHARES})"), weights)


def weighted_score(weights: Column, sbert: Column, desc: Column, marca: Column, medida: Column) -> Column:
    """Weighted sum of the four similarities, clipped to [0, 1]."""
    total = (
        weights.getField("sbert") * sbert
        + weights.getField("desc") * desc
        + weights.getField("marca") * marca
        + weights.getField("medida") * medida
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
