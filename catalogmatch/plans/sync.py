"""Keep the stores in step with the raw catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch import schemas
from catalogmatch.operators import sets
from catalogmatch.operators import standardize as st
from catalogmatch.plans.standardization import standardize_catalog
from catalogmatch.session import shared_dir, spread, wide_tasks
from catalogmatch.sources import readers, writers

BUCKETS = 256  # about a million items each at 256 million
_KINDS = {
    "display": schemas.CATALOG_DISPLAY,
    "processed": schemas.CATALOG_PROCESSED,
    "vectors": schemas.ITEM_VECTORS,
    "unit_map": schemas.UNIT_MAP,
    "cache": schemas.ITEM_CACHE,
}


@dataclass(frozen=True)
class Stores:
    """Where the synced data lives: table names or paths.

    Tables made by ``bucketed`` keep the rows of an id in one of ``buckets`` files that every store has
    alike, so the stores meet on their ids without moving a row, and of new rows only these move.
    """

    display: str
    processed: str
    vectors: str
    unit_map: str
    cache: str | None = None
    buckets: int = 0

    @classmethod
    def bucketed(cls, database: str, buckets: int = BUCKETS, cache: bool = True) -> "Stores":
        """Tables of a database, bucketed by id when ``create`` makes them."""
        return cls(*[f"{database}.{kind}" for kind in _KINDS if cache or kind != "cache"], buckets=buckets)

    @classmethod
    def below(cls, folder: str, cache: bool = True) -> "Stores":
        """Paths below one folder."""
        return cls(*[f"{folder}/{kind}" for kind in _KINDS if cache or kind != "cache"])

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        read = readers.read_small if kind == "unit_map" else readers.read_store
        return read(spark, getattr(self, kind), _KINDS[kind])

    def create(self, spark: SparkSession) -> None:
        """Create the stores that do not exist yet, empty."""
        for kind, schema in _KINDS.items():
            target = getattr(self, kind)
            if target is None:
                continue
            if self.buckets and sets.ID in schema.names:
                writers.create_bucketed(spark, target, schema, sets.ID, self.buckets)
                continue
            writer = spark.createDataFrame([], schema).write.mode("ignore")
            writer.parquet(target) if "/" in target else writer.saveAsTable(target)


def sync_stats(spark: SparkSession, new: int, total: int, first_load: bool, rehydrated: int) -> DataFrame:
    """The result of a sync as one row."""
    return spark.createDataFrame(
        [(new, total, first_load, rehydrated)],
        "new bigint, total bigint, first_load boolean, rehydrated bigint")


def _append_missing(rows: DataFrame, stored: DataFrame, target: str) -> None:
    """Append the rows whose id the store does not hold, stamped with the time."""
    missing = rows.join(stored.select(sets.ID), sets.ID, "left_anti")
    stamped = missing.withColumn("updated_at", F.current_timestamp())
    columns = [c for c in stored.columns if c in stamped.columns]
    writers.sink_append(stamped.select(columns), target)


def rehydrate_cache(spark: SparkSession, stores: Stores) -> int:
    """Copy items and vectors that the cache lacks; returns how many rows were added.

    Compared by id, not by count, so a cache with the right number of wrong rows is repaired too.
    """
    cache = stores.read(spark, "cache")
    before = cache.count()
    vectors = stores.read(spark, "vectors")
    missing = sets.missing_local(vectors, cache)
    if missing.isEmpty():
        return 0
    rows = readers.scan_items_by_ids(stores.read(spark, "processed"), vectors, missing)
    writers.sink_append(rows, stores.cache)
    return stores.read(spark, "cache").count() - before


def refresh_unit_map(raw: DataFrame, stores: Stores) -> bool:
    """Replace the stored unit map when its pairs differ from the raw table's."""
    spark = raw.sparkSession
    stored = stores.read(spark, "unit_map")
    current = st.unit_map_distinct(raw)
    if sets.unit_map_diff(current, stored).isEmpty():
        return False
    writers.sink_replace_small(current, stores.unit_map)
    return True


def sync_catalog(
    raw: DataFrame,
    stores: Stores,
    encoder: Callable[[DataFrame], DataFrame],
    model_name: str = schemas.DEFAULT_MODEL,
    dim: int = schemas.DEFAULT_DIM,
    unit_source: DataFrame | None = None,
) -> DataFrame:
    """Bring every store up to date with ``raw``; returns the statistics row.

    Nothing new means no writes except a cache repair.  Vectors are written last and each store is
    compared on its own ids, so a run that was lost half-way is completed by the next one without
    duplicates.  Items without an id or a name are left out, as they cannot be stored or standardized;
    an id that repeats among the new rows is refused before anything is written.

    ``unit_source`` is the full raw table where ``raw`` is only a part of it (streaming).
    """
    spark = raw.sparkSession
    stores.create(spark)
    vectors = stores.read(spark, "vectors")
    encoded = vectors.count()
    rehydrated = rehydrate_cache(spark, stores) if stores.cache else 0

    # the new rows are found once and read back from the shared folder by every later step; they are
    # spread first, as a file is read by one task and the texts cost far more than the bytes
    stage = shared_dir(spark, "new-items")
    spread(sets.new_items(raw, vectors)).write.parquet(stage)
    fresh = spark.read.schema(raw.schema).parquet(stage)
    repeated = sets.repeated_ids(fresh).orderBy(sets.ID).limit(5).collect()
    if repeated:
        raise ValueError(f"item ids must be unique; repeated (up to 5): {[row[sets.ID] for row in repeated]}")
    if st.split_rejects(fresh)[0].isEmpty():
        return sync_stats(spark, 0, encoded, False, rehydrated)

    usable = standardize_catalog(fresh)
    _append_missing(usable.display, stores.read(spark, "display"), stores.display)
    _append_missing(usable.processed, stores.read(spark, "processed"), stores.processed)
    texts = st.compose_embed_text(usable.processed).select(sets.ID, "embed_text").repartition(
        wide_tasks(spark), F.xxhash64(sets.ID, "embed_text"))
    new = writers.sink_vectors_checked(encoder(texts), stores.vectors, model_name, dim)
    if stores.cache:
        rehydrate_cache(spark, stores)
    refresh_unit_map(raw if unit_source is None else unit_source, stores)
    return sync_stats(spark, new, encoded + new, encoded == 0, rehydrated)


def seed_vectors(
    vectors: DataFrame,
    processed: DataFrame,
    display: DataFrame | None,
    unit_map: DataFrame | None,
    stores: Stores,
    model_name: str = schemas.DEFAULT_MODEL,
    dim: int = schemas.DEFAULT_DIM,
) -> DataFrame:
    """Load existing vectors and texts into the stores; a second run adds nothing.

    Returns one row: ids stored before, ids offered, vectors inserted.
    """
    spark = vectors.sparkSession
    stores.create(spark)
    stored = stores.read(spark, "vectors")
    counts = stored.select(sets.ID).distinct().count(), vectors.select(sets.ID).distinct().count()
    new_ids = sets.ids_except(vectors, stored)
    inserted = 0
    if not new_ids.isEmpty():
        if display is not None:
            _append_missing(sets.rows_with_ids(display, new_ids), stores.read(spark, "display"), stores.display)
        _append_missing(sets.rows_with_ids(processed, new_ids), stores.read(spark, "processed"), stores.processed)
        inserted = writers.sink_vectors_checked(
            sets.rows_with_ids(vectors, new_ids), stores.vectors, model_name, dim)
        if unit_map is not None:
            writers.sink_replace_small(unit_map, stores.unit_map)
    return spark.createDataFrame(
        [(*counts, inserted)], "stored_before bigint, offered bigint, inserted bigint")
