"""Approximate, clustered and expression-only neighbours, and ranks of given pairs."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogmatch.operators import curation, ivf, knn, lsh, pair_ranks
from catalogmatch.operators.knn_sql import knn_sql
from catalogmatch.registered import tables as t

ROWS = "vector array<float>"


def table(spark, vectors, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{key} bigint, {ROWS}").repartition(3)


def clustered_vectors(seed=1, hot=400, rest=200, dim=8):
    """One cluster with most of the items, copies, opposite and lengthless vectors."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=dim)
    items = np.concatenate([middle + 0.1 * rng.normal(size=(hot, dim)), rng.normal(size=(rest, dim)), np.tile(middle, (30, 1)), -middle[None], np.zeros((3, dim))])
    queries = np.concatenate([items[::40] + 0.05 * rng.normal(size=(len(items[::40]), dim)), np.zeros((1, dim))])
    return items, queries


@pytest.fixture(scope="module")
def tables(spark):
    items, queries = clustered_vectors()
    return table(spark, queries, "query_id").cache(), table(spark, items, "cd_insumo").cache()


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "cd_insumo", "score_sbert", "knn_rank").collect())


@pytest.mark.parametrize("k", [1, 10, 700])
def test_clustered_searches_equal_the_exact_one(tables, k):
    queries, items = tables
    wanted = rows(knn.knn_exact(queries, items, k))
    stored = ivf.cluster_items(items, clusters=12)
    assert rows(ivf.knn_ivf(queries, stored, k)) == wanted
    assert rows(ivf.knn_ivf(queries, stored, k, broadcast=False)) == wanted
    assert rows(knn_sql(queries, stored, k)) == wanted


def test_clustered_search_by_join_splits_hot_clusters(tables, monkeypatch):
    from catalogmatch.operators import cells

    queries, items = tables
    stored = ivf.cluster_items(items, clusters=4)
    small = cells.cell_best
    monkeypatch.setattr(ivf, "cell_best", lambda q, i, k: small(q, i, k, cell_queries=3, cell_items=20))
    assert rows(ivf.knn_ivf(queries, stored, 5, broadcast=False)) == rows(knn.knn_exact(queries, items, 5))


def test_clustered_search_without_queries_or_with_few_looks(spark, tables, monkeypatch):
    queries, items = tables
    stored = ivf.cluster_items(items, clusters=12)
    assert ivf.knn_ivf(queries.limit(0), stored, 3).count() == 0
    assert ivf.knn_ivf(queries.limit(0), stored, 3, broadcast=False).count() == 0
    assert knn_sql(queries.limit(0), stored, 3).count() == 0
    monkeypatch.setattr(ivf, "LOOKS", 1)  # too many pairs of query and cluster: both looks become joins
    assert rows(ivf.knn_ivf(queries, stored, 5)) == rows(knn.knn_exact(queries, items, 5))


def test_expression_search_takes_the_best_before_and_after_the_shuffle(tables):
    queries, items = tables
    plan = knn_sql(queries, ivf.cluster_items(items, clusters=12), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan and "Final" in plan
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_expression_search_refuses_unsound_queries(spark, tables):
    _, items = tables
    stored = ivf.cluster_items(items, clusters=4)
    for bad in (None, [1.0], [float("nan")] * 8):
        with pytest.raises(Exception, match="queries need vectors of 8 finite numbers"):
            knn_sql(spark.createDataFrame([(1, bad)], f"query_id bigint, {ROWS}"), stored, 2).collect()


# ---- approximate search ----

@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_lsh_finds_nine_in_ten_on_the_driver_tables(spark, scale):
    path = f"/root/testdata/sf{scale}"
    if not glob.glob(path):
        pytest.skip("no driver tables")
    from catalogmatch.registered.matching import LSH_BITS, LSH_PROBES, LSH_TABLES

    queries = t.query_vectors(spark, path).where("query_id % 100 = 0").cache()
    items = t.item_vectors(spark, path)
    true = {(r.query_id, r.cd_insumo) for r in knn.knn_exact(queries, items, 30).collect()}
    found = {(r.query_id, r.cd_insumo) for r in lsh.knn_lsh(queries, items, 30, LSH_TABLES, LSH_BITS, LSH_PROBES).collect()}
    assert len(true & found) >= 0.9 * len(true)


def test_lsh_looks_into_everything_with_all_probes(tables):
    queries, items = tables
    assert rows(lsh.knn_lsh(queries, items, 10, tables=2, bits=4, probes=16)) == rows(knn.knn_exact(queries, items, 10))


def test_lsh_buckets_agree_with_brute_force(tables):
    queries, items = tables
    own = {r.cd_insumo: np.array(r.vector) for r in items.collect()}
    normals = lsh.planes(8, 3, 5)

    def bucket(v, table):
        return sum(1 << b for b in range(5) if normals[table * 5 + b] @ v >= 0)

    wanted = set()
    for r in queries.collect():
        v = np.array(r.vector)
        near = set()
        for table in range(3):
            sides = normals[table * 5:table * 5 + 5] @ v
            order = sorted(range(32), key=lambda s: (sum(sides[b] ** 2 for b in range(5) if s >> b & 1), s))[:4]
            if not v.any():
                continue
            looked = {bucket(v, table) ^ s for s in order}
            near |= {i for i, x in own.items() if bucket(x, table) in looked}
        unit = {i: round(float(own[i] @ v / max(np.linalg.norm(own[i]) * np.linalg.norm(v), 1e-300)), 6) for i in near}
        wanted |= {(r.query_id, i) for i in sorted(unit, key=lambda i: (-unit[i], i))[:7]}
    lengthless = {r.query_id for r in queries.collect() if not any(r.vector)}
    found = {(r.query_id, r.cd_insumo) for r in lsh.knn_lsh(queries, items, 7, tables=3, bits=5, probes=4).collect() if r.query_id not in lengthless}
    assert found == wanted


def test_probes_are_chosen_for_a_recall(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 16))
    items = table(spark, vectors, "cd_insumo").cache()
    queries = table(spark, vectors[:60] + 0.2 * rng.normal(size=(60, 16)), "query_id").cache()
    probes = lsh.probes_for(queries, items, 10, recall=0.9, tables=6, bits=7)
    true = {(r.query_id, r.cd_insumo) for r in knn.knn_exact(queries, items, 10).collect()}
    found = {(r.query_id, r.cd_insumo) for r in lsh.knn_lsh(queries, items, 10, 6, 7, probes).collect()}
    assert 1 <= probes < 128
    assert len(true & found) >= 0.9 * len(true)
    assert lsh.bits_for(100) == 2 and lsh.bits_for(1_000_000) == 10


def test_lsh_without_items_or_queries(tables):
    queries, items = tables
    assert lsh.knn_lsh(queries.limit(0), items, 3).count() == 0
    assert lsh.knn_lsh(queries, items.limit(0), 3).count() == 0


# ---- ranks of given pairs ----

@pytest.mark.parametrize("way", ["stream", "grid"])
def test_ranks_are_those_of_the_whole_order(spark, tables, monkeypatch, way):
    queries, items = tables
    if way == "grid":
        monkeypatch.setattr(knn, "QUERY_ROWS", 0)
    every = {(r.query_id, r.cd_insumo): r.knn_rank for r in knn.knn_exact(queries, items, 10_000).collect()}
    pairs = [pair for i, pair in enumerate(sorted(every)) if i % 7 == 0]
    given = spark.createDataFrame([*pairs, *pairs[:5], (9999, 1), (1, 9999), (None, 1)], "query_id bigint, cd_insumo bigint")
    ranked = pair_ranks.rank_pairs(given, queries, items, cell_items=100, cell_pairs=50).collect()
    assert {(r.query_id, r.cd_insumo): r.knn_rank for r in ranked} == {pair: every[pair] for pair in pairs}
    assert len(ranked) == len(pairs)


def test_ranks_without_pairs(spark, tables):
    queries, items = tables
    assert pair_ranks.rank_pairs(spark.createDataFrame([], "query_id bigint, cd_insumo bigint"), queries, items).count() == 0


def test_a_rejected_pair_without_a_stored_rank_is_mined(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(100, 6))
    items = table(spark, vectors, "cd_insumo")
    votes = [("red pipe", "x", None, 3, 0.9, None, 0), (" Red Pipe", "X", "", 3, 0.8, 2, None), ("red pipe", "x", "", 4, 0.95, 1, 1),
             ("red pipe", "x", "", 77, 0.9, 1, 0), ("red pipe", "x", "", 5, 0.6, None, 0), ("red pipe", "x", "", 5000, 0.9, 1, 0), ("blue", "", "", 3, 0.9, 1, 0)]
    feedback = spark.createDataFrame(
        [(str(i), "s", *v) for i, v in enumerate(votes)],
        "feedback_id string, session_id string, user_descricao string, user_marca string, user_medida string, match_cd_insumo bigint,"
        "score_sbert double, rank_posicao int, label int")
    query = vectors[3] + 0.01
    far = np.argsort(-(vectors @ query) / np.linalg.norm(vectors, axis=1))
    place = {int(i): n + 1 for n, i in enumerate(far)}
    queries = spark.createDataFrame([("RED PIPE", "X", "", [float(x) for x in query])], f"key_descricao string, key_marca string, key_medida string, {ROWS}")
    hard = {r.match_cd_insumo: (r.score, r.knn_rank) for r in curation.hard_negatives(feedback, queries, items).collect()}
    assert hard == {i: (0.9, place[i]) for i in (3, 77) if place[i] <= 30}
    assert 3 in hard
    semi = {r.match_cd_insumo for r in curation.semi_hard_negatives(feedback, queries, items).collect()}
    assert semi == {i for i in (5,) if place[i] <= 30}
    assert {r.match_cd_insumo for r in curation.hard_negatives(feedback).collect()} == {3, 77, 5000}
    assert F is not None
