"""Joins, set operations and counts that keep the catalog stores in step.

All differences are ``left_anti`` joins on the item id, so only the new side is read further and no
id list ever travels through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = "cd_insumo"


def new_items(raw: DataFrame, vectors: DataFrame) -> DataFrame:
    """Raw items that have no vector yet.  A row without an id is no item and is left out."""
    return raw.where(F.col(ID).isNotNull()).join(vectors.select(ID), ID, "left_anti").select(raw.columns)


def repeated_ids(df: DataFrame) -> DataFrame:
    """Ids that stand in more than one row, with the number of their rows."""
    return df.where(F.col(ID).isNotNull()).groupBy(ID).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_local(vectors: DataFrame, cache: DataFrame) -> DataFrame:
    """Ids of encoded items that a second store does not hold."""
    return vectors.select(ID).join(cache.select(ID), ID, "left_anti")


def ids_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ids of ``left`` that are not in ``right``."""
    return left.select(ID).distinct().join(right.select(ID), ID, "left_anti")


def rows_with_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is in ``ids``; duplicates in ``ids`` change nothing."""
    return df.join(ids.select(ID), ID, "left_semi").select(df.columns)


def join_vectors(processed: DataFrame, vectors: DataFrame) -> DataFrame:
    """Processed items with their vector; items without one are left out."""
    return processed.join(vectors.select(ID, "vector"), ID)


def align_display_processed(display: DataFrame, processed: DataFrame) -> DataFrame:
    """Both forms of an item side by side, matched by id."""
    folded = processed.select(
        ID,
        F.col("insumo_descricao").alias("proc_descricao"),
        F.col("marca").alias("proc_marca"),
        F.col("medida").alias("proc_medida"),
    )
    return display.join(folded, ID)


def seed_diff(
    source_vectors: DataFrame, target_vectors: DataFrame, *tables: DataFrame
) -> tuple[DataFrame, ...]:
    """The rows of the source vectors and of further tables that the target store lacks."""
    ids = ids_except(source_vectors, target_vectors)
    return tuple(rows_with_ids(t, ids) for t in (source_vectors, *tables))


def union_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and new rows, duplicates kept; a missing ``status`` becomes null."""
    return old.unionByName(new, allowMissingColumns=True)


def unit_map_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Unit pairs ``added`` to or ``removed`` from the stored map; nulls compare equal."""
    pairs = ["cd_medida", "medida"]
    added = current.select(pairs).exceptAll(stored.select(pairs)).withColumn("change", F.lit("added"))
    removed = stored.select(pairs).exceptAll(current.select(pairs)).withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def unit_map_drift_count(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct non-null unit pairs of the raw table minus the rows stored.

    A count only: equal-sized changes go unseen, and pairs with a null always show up as drift.
    ``unit_map_diff`` has neither weakness.
    """
    now = (
        raw.select(F.concat_ws("|", "cd_medida", "medida").alias("pair"), "cd_medida", "medida")
        .where(F.col("cd_medida").isNotNull() & F.col("medida").isNotNull())
        .select("pair").distinct().select(F.lit(1).alias("sign"))
    )
    both = now.unionByName(stored.select(F.lit(-1).alias("sign")))
    return both.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("bigint").alias("drift"))


def count_totals(raw: DataFrame, vectors: DataFrame) -> DataFrame:
    """Raw rows and encoded rows in one row."""
    tagged = raw.select(F.lit(0).alias("encoded")).unionByName(vectors.select(F.lit(1).alias("encoded")))
    return tagged.agg(
        F.count_if(F.col("encoded") == 0).alias("n_raw"),
        F.count_if(F.col("encoded") == 1).alias("n_encoded"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Number of nulls per column, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls")


def catalog_sample(raw: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """``n`` rows picked by a hash of id and seed, the same ones on every run."""
    order = F.md5(F.concat(F.col(ID).cast("string"), F.lit(f"-{seed}")))
    return raw.orderBy(order, ID).limit(n)
