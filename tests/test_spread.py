from pyspark.sql import functions as F

from catalogmatch.operators import embed, sets
from catalogmatch.plans import sync
from catalogmatch.registered import tables as t
from catalogmatch.session import shared_dir


def parts_with_rows(df):
    return df.select(F.spark_partition_id()).distinct().count()


def part_table(spark):
    """One small file, which Spark reads in one task: null keys and repeated rows among them."""
    folder = shared_dir(spark, "part")
    rows = spark.range(400).selectExpr(
        "if(id % 50 = 7, null, id) p_partkey", "'name ' || id p_name", "'Brand#1' p_brand", "'TYPE' p_type", "cast(id % 9 as int) p_size")
    rows.unionByName(rows.where("p_size = 3")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def test_catalog_rows_are_dealt_over_the_tasks(spark):
    folder = part_table(spark)
    table = spark.read.parquet(f"{folder}/part.parquet")
    assert parts_with_rows(table) == 1
    for rows, rules in ((t.catalog_raw, t.RAW_RULES), (t.catalog_queries, t.QUERY_RULES)):
        got = rows(spark, folder)
        assert parts_with_rows(got) > 8
        assert got.exceptAll(table.selectExpr(*t._select(rules))).isEmpty() and got.count() == table.count()


def test_new_items_of_a_sync_are_dealt_over_the_tasks(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(sync, "standardize_catalog", lambda fresh, whole=sync.standardize_catalog: staged.append(fresh) or whole(fresh))
    path = shared_dir(spark, "raw")
    spark.range(400).selectExpr("id p_partkey", "'name ' || id p_name", "'B' p_brand", "'T' p_type", "1 p_size").selectExpr(
        *t._select(t.RAW_RULES)).coalesce(1).write.parquet(path)
    raw = spark.read.parquet(path)
    stores = sync.Stores.below(shared_dir(spark, "stores"))
    sync.sync_catalog(raw, stores, lambda df: embed.embed_hash(df, dim=8), "hash", 8)
    assert parts_with_rows(staged[0]) >= 8
    assert stores.read(spark, "vectors").select(sets.ID).distinct().count() == raw.where("insumo is not null").count()
