"""Stores bucketed by id: syncs agree with plain ones, and the stores are never moved."""

import re

import pytest
from pyspark.sql import functions as F

from catalogmatch import schemas
from catalogmatch.operators import embed, sets
from catalogmatch.plans import sync
from catalogmatch.plans.standardization import standardize_catalog
from catalogmatch.session import shared_dir

DIM = 32
KINDS = ("display", "processed", "vectors", "cache", "unit_map")


def encoder(df):
    return embed.embed_hash(df, dim=DIM)


def raw(spark, ids, unit="KG"):
    rows = [("1", i, f"Tubo {i}", "pvc", "Tigre", "Caixa", "2", unit, "KILOGRAMA", "AT") for i in ids]
    return spark.createDataFrame(rows, schemas.CATALOG_RAW)


@pytest.fixture
def stores(spark):
    folder = shared_dir(spark, "buckets")
    database = folder.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    yield sync.Stores.bucketed(database, buckets=4)
    spark.sql(f"DROP DATABASE {database} CASCADE")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def counts(spark, stores):
    return {kind: stores.read(spark, kind).count() for kind in KINDS}


def test_a_sync_into_buckets_is_incremental_and_repeatable(spark, stores):
    assert tuple(sync.sync_catalog(raw(spark, range(20)), stores, encoder, "m", DIM).first()) == (20, 20, True, 0)
    assert tuple(sync.sync_catalog(raw(spark, range(35), "G"), stores, encoder, "m", DIM).first()) == (15, 35, False, 0)
    assert tuple(sync.sync_catalog(raw(spark, range(35), "G"), stores, encoder, "m", DIM).first()) == (0, 35, False, 0)
    assert counts(spark, stores) == {"display": 35, "processed": 35, "vectors": 35, "cache": 35, "unit_map": 1}
    plain = sync.Stores.below(shared_dir(spark, "plain"))
    for part in (raw(spark, range(20)), raw(spark, range(35), "G")):
        sync.sync_catalog(part, plain, encoder, "m", DIM)
    for kind in ("display", "processed", "cache"):
        bucketed, other = (s.read(spark, kind).drop("updated_at") for s in (stores, plain))
        assert sorted(map(str, bucketed.select(other.columns).collect())) == sorted(map(str, other.collect()))


def test_a_lost_cache_is_repaired_and_seeding_adds_nothing_twice(spark, stores):
    done = standardize_catalog(raw(spark, range(12)))
    vectors = encoder(sync.st.compose_embed_text(done.processed)).select("cd_insumo", "vector")
    for wanted in ((0, 12, 12), (12, 12, 0)):
        assert tuple(sync.seed_vectors(vectors, done.processed, done.display, None, stores, "m", DIM).first()) == wanted
    assert sync.rehydrate_cache(spark, stores) == 12
    assert sync.rehydrate_cache(spark, stores) == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", ["4", "200"])
def test_stores_meet_on_their_ids_without_an_exchange(spark, stores, no_broadcast, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        sync.sync_catalog(raw(spark, range(20)), stores, encoder, "m", DIM)
        vectors, cache, processed = (stores.read(spark, kind) for kind in ("vectors", "cache", "processed"))
        assert "Exchange" not in plan_of(sets.missing_local(vectors, cache))
        assert "Exchange" not in plan_of(sets.join_vectors(processed, vectors))
        assert "Exchange" not in plan_of(sets.ids_except(vectors, cache))
        new = plan_of(sets.new_items(raw(spark, range(40)).where(F.col("cd_insumo") > 1), vectors))
        assert len(re.findall("Exchange", new)) == 1
        assert re.search(r"Exchange[^\n]*\n[^\n]*(Filter|Scan ExistingRDD|LocalTableScan)", new)  # the new rows, not the store
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
