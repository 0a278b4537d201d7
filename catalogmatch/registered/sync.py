"""Registered queries: sync, cache repair, bulk load, and the streaming sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.operators import embed, sets
from catalogmatch.plans import sync
from catalogmatch.plans.standardization import standardize_catalog
from catalogmatch.registered import sql as q
from catalogmatch.registered import tables as t
from catalogmatch.registered.catalog import PROCESSED_COLUMNS, vector_digest
from catalogmatch.registered.registry import register
from catalogmatch.session import shared_dir
from catalogmatch.sources import writers
from catalogmatch.streaming.sync_stream import sync_stream as stream_sync

DIM, MODEL = 64, "hash"
HELD = "(SELECT vec_id FROM embeddings)"
CATALOG = f"{t.RAW_SQL}, {q.catalog_ctes()}"
STATS = """SELECT {new} AS new, {total} AS total, {first} AS first_load, {rehydrated} AS rehydrated"""
NEW = f"(SELECT count(*) FROM raw WHERE insumo IS NOT NULL AND cd_insumo NOT IN {HELD})"
ALL = "(SELECT count(*) FROM raw WHERE insumo IS NOT NULL)"


def encoder(df: DataFrame) -> DataFrame:
    return embed.embed_hash(df, dim=DIM)


def prepared(spark: SparkSession, sf_dir: str, cache: bool = True) -> sync.Stores:
    """Stores that hold the texts and given vectors of every item with an embedding."""
    stores = sync.Stores.below(shared_dir(spark, "stores"), cache)
    done = standardize_catalog(t.catalog_raw(spark, sf_dir))
    vectors = t.item_vectors(spark, sf_dir)
    known = sets.rows_with_ids(vectors, done.processed)
    sync.seed_vectors(
        known, sets.rows_with_ids(done.processed, vectors), sets.rows_with_ids(done.display, vectors),
        None, stores, MODEL, DIM)
    return stores


@register(q.with_(CATALOG, then=STATS.format(
    new=NEW, total=ALL, first="false",
    rehydrated=f"(SELECT count(*) FROM processed WHERE cd_insumo IN {HELD})")))
def sync_stats(spark, sf_dir):
    """A sync over a store with some vectors and an empty cache."""
    return sync.sync_catalog(t.catalog_raw(spark, sf_dir), prepared(spark, sf_dir), encoder, MODEL, DIM)


@register(q.with_(CATALOG, then=STATS.format(new="0", total=ALL, first="false", rehydrated="0")))
def sync_idle(spark, sf_dir):
    """Nothing new: the second of two syncs."""
    stores = sync.Stores.below(shared_dir(spark, "stores"))
    raw = t.catalog_raw(spark, sf_dir)
    sync.sync_catalog(raw, stores, encoder, MODEL, DIM)
    return sync.sync_catalog(raw, stores, encoder, MODEL, DIM)


def _bucketed_stores(spark: SparkSession) -> sync.Stores:
    folder = shared_dir(spark, "buckets")
    database = folder.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    return sync.Stores.bucketed(database, buckets=8)


@register(q.with_(CATALOG, then=STATS.format(new="0", total=ALL, first="false", rehydrated="0")))
def sync_idle_bucketed(spark, sf_dir):
    """Nothing new, in tables bucketed by id."""
    stores, raw = _bucketed_stores(spark), t.catalog_raw(spark, sf_dir)
    sync.sync_catalog(raw, stores, encoder, MODEL, DIM)
    return sync.sync_catalog(raw, stores, encoder, MODEL, DIM)


SYNCED = ", ".join([CATALOG, q.hash_vectors(
    "hv", "SELECT cd_insumo, insumo_descricao || ' ' || marca || ' ' || medida AS txt FROM processed", "cd_insumo", DIM)])


@register(q.with_(SYNCED, then=f"""SELECT {PROCESSED_COLUMNS}, CASE WHEN embedding IS NULL THEN {q.digest('hv.vector')}
    ELSE {q.digest('embedding')} END AS digest FROM processed JOIN hv USING (cd_insumo)
    LEFT JOIN embeddings ON vec_id = cd_insumo"""))
def sync_catalog(spark, sf_dir):
    """The cache after a sync: given vectors where they existed, new ones elsewhere."""
    stores = prepared(spark, sf_dir)
    sync.sync_catalog(t.catalog_raw(spark, sf_dir), stores, encoder, MODEL, DIM)
    return stores.read(spark, "cache").withColumn("digest", vector_digest("vector")).drop("vector")


@register(q.with_(CATALOG, then=f"""SELECT {PROCESSED_COLUMNS}, {q.digest('embedding')} AS digest
    FROM processed JOIN embeddings ON vec_id = cd_insumo"""))
def rehydrate_cache(spark, sf_dir):
    """A cache that lost the inactive items, repaired."""
    stores = prepared(spark, sf_dir)
    active = t.catalog_raw(spark, sf_dir).where("status <> 'IN'")
    processed = sets.rows_with_ids(stores.read(spark, "processed"), active)
    writers.sink_append(
        sets.join_vectors(processed.drop("updated_at"), stores.read(spark, "vectors")), stores.cache)
    sync.rehydrate_cache(spark, stores)
    return stores.read(spark, "cache").withColumn("digest", vector_digest("vector")).drop("vector")


@register(q.with_(CATALOG, then=f"""SELECT (SELECT count(*) FROM processed WHERE cd_insumo IN {HELD}) AS stored_before,
    (SELECT count(*) FROM processed) AS offered, (SELECT count(*) FROM processed WHERE cd_insumo NOT IN {HELD}) AS inserted"""))
def seed_vectors(spark, sf_dir):
    """Offer the whole catalog to stores that hold part of it."""
    stores = prepared(spark, sf_dir, cache=False)
    done = standardize_catalog(t.catalog_raw(spark, sf_dir))
    texts = sync.st.compose_embed_text(done.processed)
    return sync.seed_vectors(
        encoder(texts).select("cd_insumo", "vector"), done.processed, done.display, None, stores, MODEL, DIM)


@register(q.with_(SYNCED, then=f"SELECT cd_insumo, {q.digest('hv.vector')} AS digest FROM hv"))
def sync_stream(spark, sf_dir):
    """The vector store after streaming the catalog in."""
    schema = t.table(spark, sf_dir, "part").schema
    parts = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir)
    stores = sync.Stores.below(shared_dir(spark, "stream"), cache=False)
    stream_sync(parts.selectExpr(*t._select(t.RAW_RULES)), stores, encoder,
                shared_dir(spark, "stream-state"), MODEL, DIM).awaitTermination()
    return stores.read(spark, "vectors").select("cd_insumo", vector_digest("vector").alias("digest"))
