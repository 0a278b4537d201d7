"""Standardize raw catalog rows and query rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogmatch.functions import measures, scoring, text
from catalogmatch.schemas import NO_BRAND
from catalogmatch.session import lookup_side


def _each(df: DataFrame, cols: Sequence[str], expression) -> DataFrame:
    return df.withColumns({c: expression(F.col(c)) for c in cols})


def fold_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower case, no accents, letters and digits only, single spaces; null becomes ``''``."""
    return _each(df, cols, text.fold)


def remove_stopwords(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop Portuguese stopwords from folded text; ``com`` and ``sem`` stay."""
    stopwords = text.portuguese_stopwords()
    return _each(df, cols, lambda c: text.drop_stopwords(c, stopwords))


def dedupe_words(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the first of equal words, in order, case-sensitively."""
    return _each(df, cols, text.distinct_words)


def strip_dot_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Delete ``.0`` anywhere in the text (``1.05`` becomes ``15``; this decides later scores)."""
    return _each(df, cols, text.without_dot_zero)


def standardize_measures(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Weights to grams, volumes to millilitres, lengths to millimetres."""
    return _each(df, cols, measures.convert_measure)


def parse_measures(df: DataFrame, col: str) -> DataFrame:
    """Add ``<col>_value`` and ``<col>_unit``."""
    parsed = df.withColumn("_parsed", measures.parse_measure(F.col(col)))
    return parsed.withColumns({
        f"{col}_value": F.col("_parsed.value"), f"{col}_unit": F.col("_parsed.unit"),
    }).drop("_parsed")


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be standardized, and rows without an item name or id, which cannot."""
    usable = F.col("insumo").isNotNull() & F.col("cd_insumo").isNotNull()
    return raw.where(usable), raw.where(~usable)


def fill_defaults(raw: DataFrame) -> DataFrame:
    """Null description, package, quantity and units become ``''``; a null brand ``SEM MARCA``."""
    return raw.fillna({
        "descricao": "", "marca": NO_BRAND, "embalagem": "", "qtd_medida": "",
        "cd_medida": "", "medida": "",
    })


def compose_item_fields(filled: DataFrame) -> DataFrame:
    """Add the composed texts: full measure, abbreviated measure, description with package.

    An empty package leaves ``()`` in the description.  A null item name gives a null description.
    """
    quantity = text.without_dot_zero(F.col("qtd_medida"))
    return filled.withColumns({
        "grp_insumo": text.without_dot_zero(F.col("grp_insumo")),
        "medida_pad": F.concat(quantity, F.col("medida")),
        "insumo_descricao": F.concat(
            "insumo", F.lit(" "), "descricao", F.lit(" ("), "embalagem", F.lit(")")),
        "medida_abv": F.concat(quantity, F.lit(" "), "cd_medida"),
    })


def project_display(composed: DataFrame) -> DataFrame:
    """Readable columns with repeated words removed; ``status`` only when the input has it."""
    out = composed.select(
        "grp_insumo", "cd_insumo", "insumo_descricao", "marca",
        F.col("medida_abv").alias("medida"),
        *(["status"] if "status" in composed.columns else []),
    )
    return dedupe_words(out, ["insumo_descricao", "marca", "medida"])


def project_processed(composed: DataFrame) -> DataFrame:
    """Columns for matching with repeated words removed, before folding."""
    out = composed.select(
        "grp_insumo", "cd_insumo", "insumo_descricao", "marca", F.col("medida_pad").alias("medida"),
    )
    return dedupe_words(out, ["insumo_descricao", "marca", "medida"])


def fold_processed(projected: DataFrame) -> DataFrame:
    """Convert measures, then fold all three texts and drop their stopwords."""
    converted = strip_dot_zero(standardize_measures(projected, ["medida"]), ["medida"])
    fields = ["insumo_descricao", "marca", "medida"]
    return remove_stopwords(fold_text(converted, fields), fields)


def unit_map_distinct(raw: DataFrame) -> DataFrame:
    """Distinct pairs of unit code and unit name."""
    return raw.select("cd_medida", "medida").distinct()


def unit_lookup(unit_map: DataFrame) -> DataFrame:
    """One name per folded unit code: the smallest, so duplicates do not depend on row order."""
    return (
        unit_map.groupBy(text.fold(F.col("cd_medida")).alias("unit_key"))
        .agg(F.min("medida").alias("unit_name"))
        .where(F.col("unit_name").isNotNull())
    )


def expand_measure(df: DataFrame, unit_map: DataFrame, col: str) -> DataFrame:
    """Replace an abbreviated unit (``11 kg``) by its full name (``11KILOGRAMA``).

    Digits must come first and letters follow directly; anything else is looked up whole, and
    what is not found keeps its text without blanks.  ``2,5KG`` therefore passes unchanged.
    """
    compact = F.replace(F.col(col), F.lit(" "), F.lit(""))
    leading = r"^(\d+)([a-zA-Z]+)"
    letters = F.regexp_extract("_compact", leading, 2)
    keyed = (
        df.withColumn("_compact", compact)
        .withColumn("_digits", F.regexp_extract("_compact", leading, 1))
        .withColumn("_key", text.fold(F.when(letters != "", letters).otherwise(F.col("_compact"))))
    )
    joined = keyed.join(
        lookup_side(unit_lookup(unit_map)), keyed["_key"] == F.col("unit_key"), "left")
    return joined.withColumn(
        col, F.coalesce(F.concat("_digits", "unit_name"), F.col("_compact"))
    ).drop("_compact", "_digits", "_key", "unit_key", "unit_name")


def standardize_queries(queries: DataFrame, unit_map: DataFrame) -> DataFrame:
    """Fold a table of queries (``query_id, descricao, marca, medida``) like the catalog.

    The given description is kept in ``consulta``; other columns pass through.  A blank measure
    stays blank.
    """
    prepared = queries.withColumns({
        "consulta": F.col("descricao"),
        "marca": F.coalesce("marca", F.lit("")),
        "medida": F.when(scoring.is_blank(F.col("medida")), "").otherwise(F.col("medida")),
    })
    expanded = expand_measure(prepared, unit_map, "medida")
    converted = strip_dot_zero(standardize_measures(expanded, ["medida"]), ["medida"])
    fields = ["descricao", "marca", "medida"]
    return remove_stopwords(fold_text(converted, fields), fields)


def _joined(*cols: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


def compose_embed_text(items: DataFrame) -> DataFrame:
    """Add ``embed_text`` for items: description, brand and measure with one blank between."""
    return items.withColumn("embed_text", _joined("insumo_descricao", "marca", "medida"))


def compose_query_text(queries: DataFrame) -> DataFrame:
    """Add ``embed_text`` for queries; the same, trimmed."""
    return queries.withColumn("embed_text", F.trim(_joined("descricao", "marca", "medida")))


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop the ``Unnamed...`` columns that an index written to CSV leaves behind."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed")])
