"""Raw catalog to its processed and display forms."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from catalogmatch.operators import standardize as st


class Standardized(NamedTuple):
    processed: DataFrame
    display: DataFrame
    rejects: DataFrame


def standardize_catalog(raw: DataFrame) -> Standardized:
    """Processed rows for matching, display rows for reading, and rows without an item name.

    Projections only: no shuffle, and each result reads just the columns it needs.
    """
    usable, rejects = st.split_rejects(raw)
    composed = st.compose_item_fields(st.fill_defaults(usable))
    return Standardized(
        st.fold_processed(st.project_processed(composed)), st.project_display(composed), rejects)
