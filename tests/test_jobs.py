"""Standardization, search, sync, feedback and metrics on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from catalogmatch import schemas
from catalogmatch.operators import embed, feedback, metrics, ranking, sets
from catalogmatch.operators import standardize as st
from catalogmatch.plans import sync
from catalogmatch.plans.search import hybrid_search
from catalogmatch.plans.standardization import standardize_catalog
from catalogmatch.session import shared_dir
from catalogmatch.sources import readers, writers
from catalogmatch.streaming.sync_stream import sync_stream

DIM = 32
ROWS = [
    ("10.0", 1, "TUBO", "PVC PVC de esgoto", "TIGRE", "Caixa", "75.0", "MM", "MILIMETRO", "AT"),
    ("10", 2, "TUBO PVC", None, None, None, "1.05", "KG", "KILOGRAMA", "IN"),
    ("11", 3, "Válvula não", "com rosca", "SEM MARCA", None, None, "PC", "PACOTE", "at"),
    ("12", 4, None, "x", "y", "z", "1", "G", "GRAMA", "AT"),
    ("13", 5, "REGISTRO", "de gaveta", "Deca Deca", "Caixa", "2", None, None, "AT"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, schemas.CATALOG_RAW)


def encoder(df):
    return embed.embed_hash(df, dim=DIM)


def test_standardized_rows(raw):
    done = standardize_catalog(raw)
    shown = {r.cd_insumo: tuple(r)[2:] for r in done.display.collect()}
    assert shown == {
        1: ("TUBO PVC de esgoto (Caixa)", "TIGRE", "75 MM", "AT"),
        2: ("TUBO PVC ()", "SEM MARCA", "15 KG", "IN"),
        3: ("Válvula não com rosca ()", "SEM MARCA", "PC", "at"),
        5: ("REGISTRO de gaveta (Caixa)", "Deca", "2", "AT"),
    }
    folded = {r.cd_insumo: tuple(r)[2:] for r in done.processed.collect()}
    assert folded == {
        1: ("tubo pvc esgoto caixa", "tigre", "75milimetro"),
        2: ("tubo pvc", "sem marca", "15000grama"),
        3: ("valvula nao com rosca", "sem marca", "pacote"),
        5: ("registro gaveta caixa", "deca", "2"),
    }
    assert [r.cd_insumo for r in done.rejects.collect()] == [4]
    assert done.display.where("cd_insumo = 1").first().grp_insumo == "10"


def test_display_without_status(raw):
    assert "status" not in standardize_catalog(raw.drop("status")).display.columns


def test_queries_expand_their_unit(spark, raw):
    units = st.unit_map_distinct(raw)
    q = spark.createDataFrame(
        [(1, "Tubo DE PVC", None, " 11 kg "), (2, "x", "Sem Marca", "2,5KG"), (3, "x", "", "  "), (4, "x", "A", "7pçs")],
        "query_id long, descricao string, marca string, medida string")
    got = {r.query_id: (r.consulta, r.descricao, r.marca, r.medida) for r in st.standardize_queries(q, units).collect()}
    assert got == {
        1: ("Tubo DE PVC", "tubo pvc", "", "11000grama"), 2: ("x", "x", "sem marca", "25kg"),
        3: ("x", "x", "", ""), 4: ("x", "x", "", "7pcs")}


def test_duplicate_unit_codes_take_the_smallest_name(spark):
    units = spark.createDataFrame([("Kg", "QUILO"), ("KG", "KILOGRAMA"), ("kg", None), (None, "NADA")], schemas.UNIT_MAP)
    q = spark.createDataFrame([(1, "3kg")], "query_id long, medida string")
    assert st.expand_measure(q, units, "medida").first().medida == "3KILOGRAMA"


def test_unit_map_differences(spark):
    now = spark.createDataFrame([("KG", "KILO"), (None, None), ("L", None)], schemas.UNIT_MAP)
    old = spark.createDataFrame([("KG", "KILOGRAMA"), (None, None), ("L", None)], schemas.UNIT_MAP)
    assert sorted((r.medida, r.change) for r in sets.unit_map_diff(now, old).collect()) == [
        ("KILO", "added"), ("KILOGRAMA", "removed")]
    assert sets.unit_map_drift_count(now, old).first().drift == -2
    assert sets.unit_map_diff(now, now).isEmpty()


def test_search_ranks_and_filters(spark, raw):
    done = standardize_catalog(raw)
    items = encoder(st.compose_embed_text(done.processed))
    q = spark.createDataFrame(
        [(1, "tubo pvc", "tigre", "75 mm"), (2, "", "", ""), (3, "registro", None, None)],
        "query_id long, descricao string, marca string, medida string")
    units = st.unit_map_distinct(raw)
    found = hybrid_search(q, items, done.display, units, encoder=encoder, threshold=0.0)
    rows = found.collect()
    best = {r.query_id: r for r in rows if r["rank"] == 1}
    assert best[1].cd_insumo == 1 and best[1].sim_marca == 1.0 and best[1].sim_medida == 1.0
    assert best[3].cd_insumo == 5 and best[3].sim_medida == 1.0
    assert sorted(r["rank"] for r in rows if r.query_id == 2) == [1, 2, 3, 4]   # ties go to the id
    assert [r.cd_insumo for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 2] == [1, 2, 3, 5]
    assert all(0 <= r.score <= 100 for r in rows)
    active = ranking.filter_active(found).collect()
    assert {r.cd_insumo for r in active} == {1, 3, 5}
    strict = hybrid_search(q, items, done.display, units, encoder=encoder, threshold=99.99)
    assert all(r.score >= 99.99 for r in strict.collect())


def test_unbounded_search_plan_gives_the_same(spark, raw, monkeypatch):
    from catalogmatch.plans import search

    done = standardize_catalog(raw)
    items = encoder(st.compose_embed_text(done.processed))
    q = spark.createDataFrame([(i, n, None, "2 kg") for i, n in enumerate(["tubo", "pvc", "registro"])],
                              "query_id long, descricao string, marca string, medida string")
    units = st.unit_map_distinct(raw)
    read = lambda: sorted(map(tuple, hybrid_search(
        q, items, done.display, units, encoder=encoder, threshold=0).select("query_id", "cd_insumo", "score", "rank").collect()))
    small = read()
    monkeypatch.setattr(search, "PAIR_ROWS", 0)
    assert read() == small and len(small) == 12


def counts(spark, stores):
    return {kind: stores.read(spark, kind).count() for kind in ("display", "processed", "vectors", "cache", "unit_map")}


def test_sync_is_incremental_and_repeatable(spark, raw):
    stores = sync.Stores.below(shared_dir(spark, "sync"))
    first = sync.sync_catalog(raw.where("cd_insumo < 3"), stores, encoder, "m", DIM).first()
    assert tuple(first) == (2, 2, True, 0)
    second = sync.sync_catalog(raw, stores, encoder, "m", DIM).first()
    assert tuple(second) == (2, 4, False, 0)
    third = sync.sync_catalog(raw, stores, encoder, "m", DIM).first()
    assert tuple(third) == (0, 4, False, 0)
    assert counts(spark, stores) == {"display": 4, "processed": 4, "vectors": 4, "cache": 4, "unit_map": 5}
    assert stores.read(spark, "vectors").where("model_name = 'm' and embedding_dim = 32").count() == 4


def test_sync_completes_a_run_lost_before_the_vectors(spark, raw):
    stores = sync.Stores.below(shared_dir(spark, "sync"))

    def broken(df):
        return encoder(df).withColumn("vector", F.slice("vector", 1, 3))

    with pytest.raises(ValueError, match=r"4 vectors do not have 32 finite numbers; ids \(up to 5\): \[1, 2, 3, 5\]"):
        sync.sync_catalog(raw, stores, broken, "m", DIM)
    assert counts(spark, stores)["vectors"] == 0
    assert sync.sync_catalog(raw, stores, encoder, "m", DIM).first().new == 4
    assert counts(spark, stores) == {"display": 4, "processed": 4, "vectors": 4, "cache": 4, "unit_map": 5}


def test_cache_is_repaired_by_id_not_by_count(spark, raw):
    stores = sync.Stores.below(shared_dir(spark, "sync"), cache=False)
    sync.sync_catalog(raw, stores, encoder, "m", DIM)
    cached = sync.Stores(stores.display, stores.processed, stores.vectors, stores.unit_map, shared_dir(spark, "cache"))
    wrong = stores.read(spark, "processed").drop("updated_at").withColumn(
        "vector", F.array(F.lit(0.0).cast("float"))).withColumn("cd_insumo", F.col("cd_insumo") + 100)
    writers.sink_append(wrong, cached.cache)
    assert sync.rehydrate_cache(spark, cached) == 4
    assert sync.rehydrate_cache(spark, cached) == 0


def test_seeding_twice_adds_nothing(spark, raw):
    stores = sync.Stores.below(shared_dir(spark, "seed"), cache=False)
    done = standardize_catalog(raw)
    vectors = encoder(st.compose_embed_text(done.processed)).select("cd_insumo", "vector")
    units = st.unit_map_distinct(raw)
    args = (vectors, done.processed, done.display, units, stores, "m", DIM)
    assert tuple(sync.seed_vectors(*args).first()) == (0, 4, 4)
    assert tuple(sync.seed_vectors(*args).first()) == (4, 4, 0)
    assert stores.read(spark, "display").count() == 4


def test_streaming_sync_over_two_landings(spark, raw):
    folder, state = shared_dir(spark, "landing"), shared_dir(spark, "state")
    stores = sync.Stores.below(shared_dir(spark, "stream"))

    def run():
        stream = spark.readStream.schema(schemas.CATALOG_RAW).parquet(folder)
        sync_stream(stream, stores, encoder, state, "m", DIM).awaitTermination()

    raw.where("cd_insumo < 3").write.parquet(folder)
    run()
    raw.write.mode("append").parquet(folder)
    run()
    assert counts(spark, stores) == {"display": 4, "processed": 4, "vectors": 4, "cache": 4, "unit_map": 5}


def test_append_of_nothing_and_union(spark, raw):
    done = standardize_catalog(raw)
    both = sets.union_append(done.processed, done.display)
    assert both.count() == 8 and both.where("status is null").count() == 4


def votes(spark, rows):
    return spark.createDataFrame(
        rows, "user_descricao string, user_marca string, user_medida string, rank_posicao int, label int")


def test_feedback_statistics(spark):
    rows = [("tubo ", None, "", 1, 1), ("TUBO", "", None, 2, 0), (" tubo", "", "", None, None),
            ("a|b", "", "", 1, 1), ("a", "b", "", 1, 1), (None, None, None, 3, 0)]
    fb = votes(spark, rows)
    assert tuple(feedback.feedback_counts(fb).first()) == (6, 3, 3)
    assert tuple(feedback.feedback_queries_3plus(fb).first()) == (4, 1)
    assert [tuple(r) for r in feedback.feedback_rank_dist(fb).collect()] == [(1, 3), (2, 1), (3, 1)]
    top = [tuple(r) for r in feedback.feedback_top_queries(fb).collect()]
    assert top == [("TUBO", 3), ("(sem descrição)", 1), ("A · marca=B", 1), ("A|B", 1)]


@pytest.mark.parametrize("total, approved, imbalanced", [(49, 49, False), (50, 50, True), (50, 37, False), (100, 76, True), (100, 75, False)])
def test_balance_limits(spark, total, approved, imbalanced):
    fb = votes(spark, [("q", "", "", 1, int(i < approved)) for i in range(total)])
    row = feedback.feedback_balance(fb).first()
    share = round(100 * approved / total, 1)
    assert (row.approved_pct, row.rejected_pct, row.imbalanced) == (share, round(100 - share, 1), imbalanced)


@pytest.mark.parametrize("total, queries, ready", [(999, 300, False), (1000, 299, False), (1000, 300, True)])
def test_readiness_limits(spark, total, queries, ready):
    fb = votes(spark, [(f"q{i % queries}", "", "", 1, 1) for i in range(total)])
    row = feedback.feedback_readiness(fb).first()
    assert row.ready is ready
    assert (row.missing_validations, row.missing_queries) == (max(0, 1000 - total), max(0, 300 - queries))
    assert (row.validations_progress, row.queries_progress) == (min(100, 100 * total // 1000), min(100, 100 * queries // 300))


def test_no_feedback(spark):
    row = feedback.feedback_readiness(votes(spark, [])).first()
    assert (row.total, row.approved_pct, row.rejected_pct, row.ready, row.missing_queries) == (0, 0.0, 0.0, False, 300)


def test_ranking_metrics(spark):
    gold = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "query_id long, expected_cd_insumo long")
    ranked = spark.createDataFrame([(1, 10, 1), (2, 99, 1), (2, 20, 2), (3, 31, 1)], "query_id long, cd_insumo long, rank int")
    assert metrics.recall_at_k(gold, ranked, 1).first().recall == 0.25
    assert metrics.recall_at_k(gold, ranked, 5).first().recall == 0.5
    assert metrics.mrr(gold, ranked).first().mrr == 0.375
    assert metrics.mrr(gold, ranked, skip_unlabelled=True).first().mrr == 0.5
    assert metrics.mrr(gold.where("false"), ranked).first().mrr == 0.0
    assert metrics.recall_at_k(gold.where("false"), ranked).first().recall == 0.0


def test_csv_round_trips(spark, raw, tmp_path):
    path = str(tmp_path / "raw")
    tricky = raw.withColumn("descricao", F.lit(' a "b", c\nd '))
    tricky.write.csv(path, header=True, escape='"', **writers.KEEP_BLANKS)
    assert {r.descricao for r in readers.scan_catalog_csv(spark, path).collect()} == {' a "b", c\nd '}
    gold = tmp_path / "gold.csv"
    gold.write_text("query_descricao,query_marca,query_medida,expected_cd_insumo\ntubo,tigre,75mm,12\nluva,,,\n")
    assert [r.expected_cd_insumo for r in readers.scan_gold(spark, str(gold)).collect()] == [12, None]
    indexed = raw.withColumn("Unnamed: 0", F.lit(1))
    assert st.drop_index_columns(indexed).columns == raw.columns


def test_id_scan_reads_one_column(spark, raw):
    path = shared_dir(spark, "vectors")
    encoder(st.compose_embed_text(standardize_catalog(raw).processed)).select("cd_insumo", "vector").write.parquet(path)
    plan = readers.scan_ids(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<cd_insumo:bigint>" in plan


def test_sync_into_tables(spark, raw):
    folder = shared_dir(spark, "db")
    database = folder.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    writers.ensure_tables(spark, database)
    stores = sync.Stores(*[f"{database}.{n}" for n in (
        "catalog_display", "catalog_processed", "item_vectors", "unit_map", "item_cache")])
    assert tuple(sync.sync_catalog(raw, stores, encoder, "m", DIM).first()) == (4, 4, True, 0)
    assert tuple(sync.sync_catalog(raw, stores, encoder, "m", DIM).first()) == (0, 4, False, 0)
    assert counts(spark, stores) == {"display": 4, "processed": 4, "vectors": 4, "cache": 4, "unit_map": 5}
    assert spark.table(stores.display).where("updated_at is not null").count() == 4
