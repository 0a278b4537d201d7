"""Sync new raw items as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from catalogmatch import schemas
from catalogmatch.operators import sets
from catalogmatch.operators import standardize as st
from catalogmatch.plans.sync import Stores, sync_catalog
from catalogmatch.sources import writers


def sync_stream(
    raw_stream: DataFrame,
    stores: Stores,
    encoder: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    model_name: str = schemas.DEFAULT_MODEL,
    dim: int = schemas.DEFAULT_DIM,
) -> StreamingQuery:
    """Run ``sync_catalog`` on each micro-batch until the landing folder is read.

    A batch delivered twice adds nothing, because every store is compared on its own ids.  A batch
    holds only part of the catalog, so the unit map is extended with its pairs, never cut to them.
    """
    def on_batch(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stores.create(spark)
        stored = stores.read(spark, "unit_map")
        known = st.unit_map_distinct(stored.unionByName(batch.select("cd_medida", "medida")))
        added = sets.unit_map_diff(known, stored).where("change = 'added'").drop("change")
        sync_catalog(batch, stores, encoder, model_name, dim, unit_source=stored)
        if not added.isEmpty():
            writers.sink_replace_small(stored.unionByName(added), stores.unit_map)

    return (
        raw_stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
