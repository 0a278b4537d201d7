"""Inputs that must be refused or complete: numbers, ids, folders, large query tables, open windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogmatch import schemas, session
from catalogmatch.operators import curation, embed, ivf, knn
from catalogmatch.plans import sync
from catalogmatch.sources import writers
from catalogmatch.streaming.feedback_stream import hourly

DIM = 16


def vectors(spark, n, seed=1, key="cd_insumo", bad=()):
    rows = np.random.default_rng(seed).normal(size=(n, 4)).astype(np.float32)
    for i in bad:
        rows[i, 2] = np.nan
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"{key} long, vector array<float>")


@pytest.mark.parametrize("bad", [(0,), (1, 5, 9), tuple(range(5)), tuple(range(7))])
def test_search_refuses_numbers_that_are_not_finite(spark, bad):
    with pytest.raises(Exception, match="finite"):
        knn.knn_exact(vectors(spark, 3, 2, "query_id"), vectors(spark, 100, bad=bad), 5).collect()


def test_store_refuses_numbers_that_are_not_finite(spark, tmp_path):
    items = vectors(spark, 4, bad=(2,))
    good, wrong = writers.split_bad_vectors(items, 4)
    assert good.count() == 3 and [r.cd_insumo for r in wrong.collect()] == [2]
    with pytest.raises(ValueError, match="finite"):
        writers.sink_vectors_checked(items, f"{tmp_path}/v", "m", 4)


def test_clustered_search_in_blocks_equals_exact_search(spark, monkeypatch):
    items, queries = vectors(spark, 400), vectors(spark, 60, 3, "query_id")
    want = sorted(tuple(r) for r in knn.knn_exact(queries, items, 4).collect())
    clustered = ivf.cluster_items(items, clusters=6)
    monkeypatch.setattr(knn, "QUERY_ROWS", 20)
    assert sorted(tuple(r) for r in ivf.knn_ivf(queries, clustered, 4).collect()) == want


def test_sizing_queries_runs_no_encoder(spark):
    calls = spark.sparkContext.accumulator(0)

    def vector(text):
        calls.add(1)
        return [float(len(text)), 1.0, 2.0, 3.0]

    queries = spark.range(50).select(F.col("id").alias("query_id"), F.udf(vector, "array<float>")(F.col("id").cast("string")).alias("vector"))
    knn.knn_exact(queries, vectors(spark, 30), 2).collect()
    assert calls.value <= 60  # each text once, and one row to learn the length


def test_sync_rejects_missing_and_repeated_ids(spark, tmp_path):
    raw = [("10", 1, "TUBO", "PVC", "TIGRE", "Caixa", "75", "MM", "MILIMETRO", "AT"), ("10", None, "SEM", "ID", "X", "Y", "1", "KG", "KILOGRAMA", "AT")]
    stores = sync.Stores.below(f"{tmp_path}/s")

    def run(rows):
        return sync.sync_catalog(spark.createDataFrame(rows, schemas.CATALOG_RAW), stores, lambda df: embed.embed_hash(df, dim=DIM), "hash", DIM).first()

    assert [run(raw).new for _ in range(3)] == [1, 0, 0]
    assert [stores.read(spark, kind).count() for kind in ("display", "processed", "vectors", "cache")] == [1, 1, 1, 1]
    twice = ("11", 2, "REGISTRO", "a", "b", "c", "1", "G", "GRAMA", "AT")
    with pytest.raises(ValueError, match="unique"):
        run([*raw, twice, twice])
    assert stores.read(spark, "display").count() == 1


def test_only_one_machine_may_go_without_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session._local_dir(master)
    assert session._local_dir("local[4]") and session._local_dir("local")


VOTE = "feedback_id string, timestamp_utc timestamp, session_id string, user_descricao string, user_marca string, user_medida string, " \
       "match_cd_insumo long, score_sbert double, score_final double, rank_posicao int, label int"


@pytest.fixture(scope="module")
def votes(spark):
    def vote(i, session_id, label, item=1, query="q", minute=0):
        return (str(i), f"2024-01-01 00:{minute:02d}:00", session_id, query, None, "", item, 0.8, 80.0, 1 + i % 4, label)

    rows = [vote(0, "a", 1), vote(1, "b", 0), vote(2, "c", 1), vote(3, "a", 0, 2), vote(4, "b", 1, 2), vote(5, "a", 1, 3), vote(6, "a", 0, 3, minute=9),
            vote(7, None, None, 4), vote(8, "c", 1, 5, None), vote(9, "c", 1, 5, " Q "), vote(9, "c", 1, 5, " Q ")]
    text = VOTE.replace("timestamp_utc timestamp", "timestamp_utc string")
    return spark.createDataFrame(rows, text).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))


def test_votes_are_resolved(votes):
    found = {(r.key_descricao, r.match_cd_insumo): (r.votes, r.approved, r.outcome) for r in curation.resolve_votes(votes).collect()}
    # item 2 is contested by two votes only; of item 3 the last vote of its one session counts
    assert found == {("Q", 1): (3, 2, "approved"), ("Q", 3): (1, 0, "rejected"), ("Q", 4): (1, 0, "rejected"), ("", 5): (1, 1, "approved"),
                     ("Q", 5): (1, 1, "approved")}
    assert {r.match_cd_insumo for r in curation.contradictions(votes).collect()} == {1, 2}


def test_splits_and_classes(votes, spark):
    assert curation.leak_check(curation.split_by_query(votes)).count() == 0
    many = spark.range(1000).select(F.col("id").cast("string").alias("feedback_id"), (F.col("id") % 10 != 0).cast("int").alias("label"))
    kept = {r.label: r["count"] for r in curation.balance_classes(many).groupBy("label").count().collect()}
    assert kept == {0: 100, 1: 150}
    assert curation.balance_classes(many.where("label = 1")).count() == 0
    assert curation.cap_per_query(votes, 2).groupBy(*curation.KEY).count().agg(F.max("count")).first()[0] == 2


def test_annotators(votes):
    agreement = {r.session_id: (r.pairs, r.compared, r.agreed) for r in curation.annotator_agreement(votes).collect()}
    assert agreement == {"a": (2, 3, 1), "b": (2, 3, 0), "c": (1, 2, 1)}
    weights = {r.session_id: (r.votes, r.weight) for r in curation.annotator_weights(votes).collect()}
    assert weights == {"a": (2, 1.0), "b": (1, 0.0), "c": (3, 1.0)}


def test_statistics_of_no_votes(votes):
    none = votes.limit(0)
    assert tuple(curation.label_distribution(none).first()) == (0, 0, None)
    assert curation.training_manifest(none).first().queries == 0
    for df in (curation.latest_votes(none), curation.hard_negatives(none), curation.eval_report(none, "session_id"), curation.annotator_agreement(none)):
        assert df.count() == 0


def test_hourly_counts_hold_open_windows_and_each_vote_once(votes):
    assert [tuple(r)[2:] for r in hourly(votes).collect()] == [(10, 6, 4)]
