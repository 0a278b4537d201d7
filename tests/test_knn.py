import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogmatch.operators import ivf, knn
from catalogmatch.operators import knn_sql as sql_neighbours


def frames(spark, queries, items, parts=4):
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, vector array<float>")
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)], "cd_insumo long, vector array<float>")
    return q, d.repartition(parts)


def brute(queries, items, k):
    def unit(m):
        m = np.asarray(m, np.float32).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    sims = np.round(unit(queries) @ unit(items).T, 6) + 0.0
    out = []
    for i, row in enumerate(sims):
        for rank, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j))[:k], 1):
            out.append((i, j, min(1.0, max(0.0, row[j])), rank))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "cd_insumo", "score_sbert", "knn_rank").collect())


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    items = rng.normal(size=(900, 16))
    items[300:600] = items[299]          # a third of all items are copies of one
    items[10] = 0                        # no length
    queries = np.vstack([rng.normal(size=(40, 16)), items[299:301], np.zeros((1, 16))])
    return queries, items


@pytest.mark.parametrize("k", [1, 7, 400])
def test_scan_and_grid_equal_brute_force(spark, sample, k):
    queries, items = sample
    q, d = frames(spark, queries, items)
    expected = sorted(brute(queries, items, k))
    assert rows(knn.knn_exact(q, d, k)) == expected
    assert rows(knn.knn_grid(q, d, k, cell_queries=11, cell_items=100)) == expected


def test_spread_plan_gives_the_same(spark, sample, monkeypatch):
    queries, items = sample
    q, d = frames(spark, queries, items)
    monkeypatch.setattr(knn, "SPREAD_QUERIES", 1)
    assert rows(knn.knn_exact(q, d, 5)) == sorted(brute(queries, items, 5))


def test_large_query_tables_take_the_grid(spark, sample, monkeypatch):
    queries, items = sample
    q, d = frames(spark, queries, items)
    monkeypatch.setattr(knn, "QUERY_ROWS", 10)
    plan = knn.knn_exact(q, d, 5)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
    assert rows(knn.knn_exact(q, d, 5)) == sorted(brute(queries, items, 5))


def test_several_blocks_in_one_task():
    rng = np.random.default_rng(2)
    queries, items = rng.normal(size=(50, 8)), rng.normal(size=(500, 8))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.arange(500)
    blocks = [(ids[i:i + 90], unit(items)[i:i + 90]) for i in range(0, 500, 90)]
    got = set()
    for table in knn._best_of(np.arange(50), unit(queries), 6, iter(blocks), rows=20, cols=40):
        got |= {(r["query_id"], r["cd_insumo"]) for r in table.to_pylist()}
    expected = unit(queries) @ unit(items).T
    assert got == {(i, j) for i in range(50) for j in np.argsort(-expected[i])[:6]}


def test_fewer_items_than_k_returns_all(spark):
    q, d = frames(spark, [[1, 0]], [[1, 0], [0, 1], [-1, 0]])
    assert rows(knn.knn_exact(q, d, 30)) == [(0, 0, 1.0, 1), (0, 1, 0.0, 2), (0, 2, 0.0, 3)]


def test_no_items_and_no_queries(spark):
    q, d = frames(spark, [[1, 0]], [[1, 0]])
    assert rows(knn.knn_exact(q, d.where("false"), 3)) == []
    assert rows(knn.knn_exact(q.where("false"), d, 3)) == []
    assert rows(knn.knn_grid(q, d.where("false"), 3)) == []


def test_wrong_length_and_missing_vectors_are_errors(spark):
    q, d = frames(spark, [[1, 0]], [[1, 0], [1, 0, 0]])
    with pytest.raises(Exception, match="must have 2 numbers"):
        knn.knn_exact(q, d, 3).collect()
    missing = d.withColumn("vector", F.lit(None).cast("array<float>"))
    with pytest.raises(Exception, match="some rows have none"):
        knn.knn_exact(q, missing, 3).collect()


@pytest.mark.parametrize("k", [1, 7, 400, 2000])
def test_clustered_search_equals_brute_force(spark, sample, k):
    queries, items = sample
    q, d = frames(spark, queries, items)
    clustered = ivf.cluster_items(d, clusters=12)
    assert clustered.sizes.sum() == len(items) and clustered.sizes[-1] == 1
    assert rows(ivf.knn_ivf(q, clustered, k)) == sorted(brute(queries, items, k))
    assert rows(ivf.knn_ivf(q.where("false"), clustered, k)) == []


def test_clustered_search_skips_far_clusters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    middles = np.eye(8) * 10
    items = np.vstack([middles[i % 8] + rng.normal(scale=0.1, size=8) for i in range(800)])
    q, d = frames(spark, items[:5], items)
    clustered = ivf.cluster_items(d, clusters=8)
    read = []
    stream = ivf._stream
    monkeypatch.setattr(ivf, "_stream", lambda i, a, b, looks, k, s: read.append(looks.num_rows) or stream(i, a, b, looks, k, s))
    assert rows(ivf.knn_ivf(q, clustered, 10)) == sorted(brute(items[:5], items, 10))
    assert sum(read) < 5 * 8


def test_grid_rows_go_to_few_tasks(spark, sample):
    # a grid of 41 x 33 cells sent every row to 41 or 33 of them and merged 33 lists of each query
    assert knn._blocks(16_000, 10_000, 400, 300, 16) == (4, 4)
    assert knn._blocks(2_000_000, 2_000_000, 400, 300, 16) == (31, 16)
    assert knn._blocks(10, 10, 400, 300, 16) == (1, 1)
    assert knn._blocks(50, 900, 11, 100, 200) == (5, 10)
    queries, items = sample
    q, d = frames(spark, np.vstack([queries] * 8), items)
    merged = knn._grid(*knn._select(q, d), 5, 3, 9).count()
    assert merged <= 8 * len(queries) * 5 * 16  # with every cell for itself, 101 lists a query


def test_pairs_of_one_cluster_are_compared_in_many_tasks(spark):
    q = spark.range(200).selectExpr("id query_id", "array(1d, 0d) unit").coalesce(1)
    near = spark.range(200).selectExpr("id query_id", "cast(id % 2 as int) cluster").coalesce(1)
    d = spark.range(60).selectExpr("id cd_insumo", "array(0.5d, id / 60d) own", "cast(id % 2 as int) cluster").coalesce(1)
    pairs = sql_neighbours._best(q, near, d.unionByName(d), 2)
    assert pairs.select(F.spark_partition_id()).distinct().count() > 4
    got = sorted((r.query_id, r.cd_insumo) for r in pairs.collect())
    assert got == sorted((i, j) for i in range(200) for j in range(60) for _ in range(2) if i % 2 == j % 2)


def test_items_are_ruled_out_by_their_leading_directions(monkeypatch):
    rng = np.random.default_rng(5)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    few = rng.normal(size=(6, 64))
    items = unit(rng.normal(size=(6_000, 6)) @ few + 0.1 * rng.normal(size=(6_000, 64)))
    items[1_000:1_400] = items[999]       # copies, whose order is that of their ids
    queries = unit(rng.normal(size=(300, 6)) @ few + 0.1 * rng.normal(size=(300, 64)))
    queries[:3] = items[999]
    assert knn._directions(items).shape == (64, 14)
    assert knn._directions(unit(rng.normal(size=(2_000, 64)))) is None  # alike in all directions: nothing to gain
    short, dots = [], knn._dots
    monkeypatch.setattr(knn, "_dots", lambda a, i, b, j: short.append(len(i)) or dots(a, i, b, j))
    ids = rng.permutation(6_000)
    blocks = [(ids[low:low + 900], items[low:low + 900]) for low in range(0, 6_000, 900)]
    got = [r for table in knn._best_of(np.arange(300), queries, 7, iter(blocks), rows=128, cols=500) for r in table.to_pylist()]
    sims = np.round(queries @ items.T, 6)
    expected = {(i, int(ids[j])) for i, row in enumerate(sims) for j in sorted(range(6_000), key=lambda j: (-row[j], ids[j]))[:7]}
    assert len(got) == len(expected) and {(r["query_id"], r["cd_insumo"]) for r in got} == expected
    assert sum(short) < 0.1 * 300 * 6_000


@pytest.mark.parametrize("compiled, k", [(0, 7), (0, 2000), (10 ** 9, 7)])
def test_search_in_expressions_equals_brute_force(spark, sample, monkeypatch, compiled, k):
    queries, items = sample
    q, d = frames(spark, queries, items)
    monkeypatch.setattr(sql_neighbours, "COMPILED", compiled)
    before = spark.conf.get("spark.sql.codegen.maxFields")
    clustered = ivf.cluster_items(d, clusters=12)
    assert rows(sql_neighbours.knn_sql(q, clustered, k)) == sorted(brute(queries, items, k))
    assert rows(sql_neighbours.knn_sql(q.where("false"), clustered, k)) == []
    assert spark.conf.get("spark.sql.codegen.maxFields") == before


def test_only_pairs_that_may_be_among_the_best_leave_the_join(spark):
    rng = np.random.default_rng(6)
    items = rng.normal(size=(4_000, 64))
    unit = items / np.linalg.norm(items, axis=1, keepdims=True)
    q = spark.createDataFrame([(i, unit[i].tolist()) for i in range(20)], "query_id long, unit array<double>")
    d = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(unit)], "cd_insumo long, own array<double>, cluster int")
    near = q.select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("cluster"))
    wide = sql_neighbours._wide_session(spark, 64)
    assert wide.conf.get("spark.sql.session.timeZone") == "UTC" and wide.conf.get("spark.sql.shuffle.partitions") == "8"
    assert int(wide.conf.get("spark.sql.codegen.maxFields")) >= 2 * 64 + 2
    floors = {r.query_id: r.floor for r in sql_neighbours._floors(q, near, d, 2, 10, 64).collect()}
    tenth = -np.sort(-(unit[:20] @ unit.T), axis=1)[:, 9]
    assert all(tenth[i] - 0.1 < floors[i] <= tenth[i] + 1e-9 for i in range(20))
    floored = near.join(spark.createDataFrame(list(floors.items()), "query_id long, floor double"), "query_id")
    pairs = sql_neighbours._best(q, floored, d, 2, 64)
    assert 10 * 20 <= pairs.count() < 0.02 * 20 * 4_000  # all 80,000 pairs went on to the sort before
