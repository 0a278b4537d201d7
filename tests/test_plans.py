"""The plans that matter at scale: no needless shuffle, pruned scans, one Python pass."""

import pytest

from catalogmatch import schemas
from catalogmatch.operators import embed, feedback, knn, sets
from catalogmatch.operators import standardize as st
from catalogmatch.plans.search import hybrid_search
from catalogmatch.plans.standardization import standardize_catalog
from catalogmatch.session import shared_dir


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark):
    path = shared_dir(spark, "plan-raw")
    spark.range(100).selectExpr(
        "'1' grp_insumo", "id cd_insumo", "'TUBO ' || id insumo", "'pvc' descricao", "'TIGRE' marca", "'Caixa' embalagem",
        "'2' qtd_medida", "'KG' cd_medida", "'KILOGRAMA' medida", "'AT' status").write.parquet(path)
    return spark.read.schema(schemas.CATALOG_RAW).parquet(path)


@pytest.fixture(scope="module")
def vectors(spark, raw):
    path = shared_dir(spark, "plan-vectors")
    texts = st.compose_embed_text(standardize_catalog(raw).processed)
    embed.embed_hash(texts, dim=32).select("cd_insumo", "vector").write.parquet(path)
    return spark.read.parquet(path)


def test_standardizing_needs_no_shuffle_and_no_python(raw):
    done = standardize_catalog(raw)
    for df in done:
        assert "Exchange" not in physical(df) and "Python" not in physical(df)
    assert "status" not in physical(done.processed).split("ReadSchema")[1]


def test_embedding_by_hash_stays_in_the_jvm(raw):
    plan = physical(embed.embed_hash(st.compose_embed_text(standardize_catalog(raw).processed)))
    assert "Exchange" not in plan and "Python" not in plan


def test_new_items_is_an_anti_join_on_the_id_column(raw, vectors):
    plan = physical(sets.new_items(raw, vectors))
    assert "LeftAnti" in plan and "ReadSchema: struct<cd_insumo:bigint>" in plan


def test_statistics_aggregate_before_the_shuffle(spark):
    fb = spark.createDataFrame([("a", "b", "c", 1)], "user_descricao string, user_marca string, user_medida string, label int")
    assert "partial_count" in physical(feedback.feedback_query_counts(fb))


def test_items_are_not_shuffled_for_few_queries(spark, vectors):
    queries = vectors.limit(5).withColumnRenamed("cd_insumo", "query_id")
    plan = physical(knn.knn_exact(queries, vectors, 3))
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(query_id" in plan
    assert plan.index("MapInArrow") > plan.index("Exchange")     # the shuffle stands above the scan


def test_search_compares_texts_once(spark, raw, vectors):
    done = standardize_catalog(raw)
    items = sets.join_vectors(done.processed, vectors)
    queries = spark.createDataFrame(
        [(1, "tubo 1 pvc caixa", "tigre", "2 kg")], "query_id long, descricao string, marca string, medida string")
    found = hybrid_search(
        queries, items, done.display, st.unit_map_distinct(raw), encoder=lambda df: embed.embed_hash(df, dim=32))
    plan = physical(found)
    assert plan.count("ArrowEvalPython") == 1
    assert found.where("rank = 1").first().cd_insumo == 1
