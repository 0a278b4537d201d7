"""Registered queries: vectors, neighbours, similarities, scores, ranking and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.operators import embed, ivf, knn, lsh, metrics, ranking
from catalogmatch.operators import standardize as st
from catalogmatch.operators.knn_sql import knn_sql as sql_knn
from catalogmatch.plans.search import hybrid_search as search
from catalogmatch.plans.standardization import standardize_catalog
from catalogmatch.registered import sql as q
from catalogmatch.registered import tables as t
from catalogmatch.registered.catalog import vector_digest
from catalogmatch.registered.registry import register
from catalogmatch.session import shared_dir
from catalogmatch.sources import readers, writers

K, THRESHOLD = 30, 30.0
WEIGHTS = {"sbert": 0.4, "desc": 0.2, "marca": 0.2, "medida": 0.2}

CATALOG = f"{t.RAW_SQL}, {t.UNITS_SQL}, {t.QUERIES_SQL}, {q.catalog_ctes()}, {q.query_ctes()}"
ITEMS = "items AS MATERIALIZED (SELECT cd_insumo, embedding AS vector FROM processed JOIN embeddings ON cd_insumo = vec_id)"
KNN = f"{t.QUERY_VECTORS_SQL}, {q.knn_ctes('qv', 'items', K)}"
PAIRS = """SELECT query_id, k.cd_insumo, score_sbert, consulta, q.descricao AS q_descricao, q.marca AS q_marca, q.medida AS q_medida,
    p.insumo_descricao AS d_descricao, p.marca AS d_marca, p.medida AS d_medida
    FROM {knn} k JOIN q USING (query_id) JOIN processed p ON p.cd_insumo = k.cd_insumo"""
SIMS = f"{CATALOG}, {ITEMS}, {KNN}, {q.sims_ctes(PAIRS.format(knn='knn'))}"
WEIGHTED = f"{SIMS}, {q.weight_ctes(tuple(WEIGHTS.values()))}"
RANKED = f"{WEIGHTED}, {q.ranked_cte(THRESHOLD)}"
RESULT = """SELECT query_id, r.cd_insumo, d.grp_insumo, d.insumo_descricao, d.marca, d.medida, d.status, consulta, score_sbert,
    round(sim_desc, 6) AS sim_desc, round(sim_marca, 6) AS sim_marca, round(sim_medida, 6) AS sim_medida,
    round(score, 6) AS score, rank FROM ranked r JOIN display d ON d.cd_insumo = r.cd_insumo"""


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    processed = standardize_catalog(t.catalog_raw(spark, sf_dir)).processed
    return readers.scan_items_with_vectors(processed, t.item_vectors(spark, sf_dir))


def folded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that have a vector; no other is looked for."""
    units = st.unit_map_distinct(t.catalog_raw(spark, sf_dir))
    asked = t.catalog_queries(spark, sf_dir).join(t.query_vectors(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    return st.standardize_queries(asked, units)


def given_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-neighbour candidates with the folded texts of both sides."""
    items = vector_items(spark, sf_dir)
    found = knn.knn_exact(t.query_vectors(spark, sf_dir), items, K).drop("knn_rank")
    texts = folded_queries(spark, sf_dir).select(
        "query_id", "consulta", F.col("descricao").alias("q_descricao"), F.col("marca").alias("q_marca"),
        F.col("medida").alias("q_medida"))
    docs = items.select(
        "cd_insumo", F.col("insumo_descricao").alias("d_descricao"), F.col("marca").alias("d_marca"),
        F.col("medida").alias("d_medida"))
    return found.join(ranking.with_parts(texts, "q"), "query_id").join(ranking.with_parts(docs, "d"), "cd_insumo")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.combine_score(
        ranking.effective_weights(ranking.attribute_sims(given_pairs(spark, sf_dir)), WEIGHTS))


def search_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = t.catalog_queries(spark, sf_dir).join(t.query_vectors(spark, sf_dir), "query_id")
    raw = t.catalog_raw(spark, sf_dir)
    return search(
        queries, vector_items(spark, sf_dir), standardize_catalog(raw).display,
        st.unit_map_distinct(raw), k=K, weights=WEIGHTS, threshold=THRESHOLD)


# ---- vectors ----

EMBEDDED = f"{t.RAW_SQL}, {q.catalog_ctes()}, " + q.hash_vectors(
    "hv", "SELECT cd_insumo, insumo_descricao || ' ' || marca || ' ' || medida AS txt FROM processed", "cd_insumo")


def texts_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.compose_embed_text(standardize_catalog(t.catalog_raw(spark, sf_dir)).processed)


@register(q.with_(EMBEDDED, then=f"SELECT cd_insumo, {q.digest('vector')} AS digest FROM hv"))
def embed_hash(spark, sf_dir):
    return embed.embed_hash(texts_to_embed(spark, sf_dir)).select("cd_insumo", vector_digest("vector").alias("digest"))


@register(q.with_(EMBEDDED, then=f"SELECT cd_insumo, {q.digest('vector')} AS digest FROM hv"))
def embed_items(spark, sf_dir):
    encoded = embed.embed_items(texts_to_embed(spark, sf_dir), embed.hash_encoder())
    return encoded.select("cd_insumo", vector_digest("vector").alias("digest"))


@register("""SELECT a.vec_id AS cd_insumo, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score_sbert
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_scores(spark, sf_dir):
    own = t.item_vectors(spark, sf_dir)
    other = own.select((F.col("cd_insumo") - 1).alias("cd_insumo"), F.col("vector").alias("other"))
    scored = ranking.cosine_scores(own.join(other, "cd_insumo"), "vector", "other")
    return rounded(scored.select("cd_insumo", "score_sbert"), "score_sbert")


ALL_ITEMS = "items AS (SELECT vec_id AS cd_insumo, embedding AS vector FROM embeddings)"


@register(q.with_(ALL_ITEMS, KNN, then="SELECT query_id, cd_insumo, score_sbert, knn_rank FROM knn"))
def knn_exact(spark, sf_dir):
    return knn.knn_exact(t.query_vectors(spark, sf_dir), t.item_vectors(spark, sf_dir), K)


@register(q.with_(ALL_ITEMS, KNN, then="SELECT query_id, cd_insumo, score_sbert, knn_rank FROM knn"))
def knn_grid(spark, sf_dir):
    return knn.knn_grid(
        t.query_vectors(spark, sf_dir), t.item_vectors(spark, sf_dir), K, cell_queries=400, cell_items=300)


@register(q.with_(ALL_ITEMS, KNN, then="SELECT query_id, cd_insumo, score_sbert, knn_rank FROM knn"))
def knn_ivf(spark, sf_dir):
    clustered = ivf.cluster_items(t.item_vectors(spark, sf_dir), clusters=16)
    return ivf.knn_ivf(t.query_vectors(spark, sf_dir), clustered, K)


@register(q.with_(ALL_ITEMS, KNN, then="SELECT query_id, cd_insumo, score_sbert, knn_rank FROM knn"))
def knn_ivf_joined(spark, sf_dir):
    """The plan for query tables too large to broadcast."""
    clustered = ivf.cluster_items(t.item_vectors(spark, sf_dir), clusters=16)
    return ivf.knn_ivf(t.query_vectors(spark, sf_dir), clustered, K, broadcast=False)


@register(q.with_(ALL_ITEMS, KNN, then="SELECT query_id, cd_insumo, score_sbert, knn_rank FROM knn"))
def knn_sql(spark, sf_dir):
    clustered = ivf.cluster_items(t.item_vectors(spark, sf_dir), clusters=16)
    return sql_knn(t.query_vectors(spark, sf_dir), clustered, K)


LSH_TABLES, LSH_BITS, LSH_PROBES = 8, 6, 12
HUNDREDTH = "SELECT query_id, vector FROM qv WHERE query_id % 100 = 0"


@register(q.with_(ALL_ITEMS, t.QUERY_VECTORS_SQL, q.lsh_ctes(HUNDREDTH, "items", lsh.planes(64, LSH_TABLES, LSH_BITS), LSH_TABLES, LSH_PROBES, K),
                  then="SELECT query_id, cd_insumo, score_sbert, knn_rank FROM lsh"))
def knn_lsh(spark, sf_dir):
    queries = t.query_vectors(spark, sf_dir).where("query_id % 100 = 0")
    return lsh.knn_lsh(queries, t.item_vectors(spark, sf_dir), K, LSH_TABLES, LSH_BITS, LSH_PROBES)


# ---- similarities ----

SUCCESSORS = """SELECT a.cd_insumo AS query_id, b.cd_insumo, 0.5::DOUBLE AS score_sbert, a.insumo_descricao AS q_descricao, a.marca AS q_marca,
    a.medida AS q_medida, b.insumo_descricao AS d_descricao, b.marca AS d_marca, b.medida AS d_medida
    FROM processed a JOIN processed b ON b.cd_insumo = a.cd_insumo + 9"""


def item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every processed item beside the one nine ids on, which has the same unit."""
    own = standardize_catalog(t.catalog_raw(spark, sf_dir)).processed
    left = own.select(
        F.col("cd_insumo").alias("query_id"), F.col("insumo_descricao").alias("q_descricao"),
        F.col("marca").alias("q_marca"), F.col("medida").alias("q_medida"))
    right = own.select(
        "cd_insumo", (F.col("cd_insumo") - 9).alias("query_id"), F.col("insumo_descricao").alias("d_descricao"),
        F.col("marca").alias("d_marca"), F.col("medida").alias("d_medida"))
    return left.join(right, "query_id")


@register(q.with_(t.RAW_SQL, q.catalog_ctes(), f"pairs AS ({SUCCESSORS})",
                  q.ratio_ctes("rd", "SELECT q_descricao AS a, d_descricao AS b FROM pairs"),
                  then="SELECT query_id, cd_insumo, round(ratio, 6) AS sim FROM pairs JOIN rd ON a = q_descricao AND b = d_descricao"))
def sim_tokens(spark, sf_dir):
    scored = ranking.sim_tokens(item_pairs(spark, sf_dir), "q_descricao", "d_descricao")
    return rounded(scored.select("query_id", "cd_insumo", "sim"), "sim")


@register(q.with_(t.RAW_SQL, q.catalog_ctes(), q.sims_ctes(SUCCESSORS),
                  then="SELECT query_id, cd_insumo, round(sim_medida, 6) AS sim FROM sims"))
def sim_measures(spark, sf_dir):
    scored = ranking.sim_measures(item_pairs(spark, sf_dir), "q_medida", "d_medida")
    return rounded(scored.select("query_id", "cd_insumo", "sim"), "sim")


SIM_NAMES = ("sim_desc", "sim_marca", "sim_medida")
ROUND_SIMS = ", ".join(f"round({c}, 6) AS {c}" for c in SIM_NAMES)


@register(q.with_(SIMS, then=f"SELECT query_id, cd_insumo, {ROUND_SIMS} FROM sims"))
def attribute_sims(spark, sf_dir):
    sims = ranking.attribute_sims(given_pairs(spark, sf_dir))
    return rounded(sims.select("query_id", "cd_insumo", *SIM_NAMES), *SIM_NAMES)


@register("""WITH w AS (SELECT event_id, CAST(user_id % 3 AS DOUBLE) AS s, CAST(event_id % 2 AS DOUBLE) AS d,
        CAST(event_id % 5 AS DOUBLE) / 2 AS m, 0.0::DOUBLE AS x FROM events),
    z AS (SELECT *, s + d + m + x AS t FROM w)
    SELECT event_id, round(CASE WHEN t <= 0 THEN 0.5 ELSE s / t END, 6) AS sbert, round(CASE WHEN t <= 0 THEN 0.0 ELSE d / t END, 6) AS "desc",
    round(CASE WHEN t <= 0 THEN 0.25 ELSE m / t END, 6) AS marca, round(CASE WHEN t <= 0 THEN 0.25 ELSE x / t END, 6) AS medida FROM z""")
def normalize_weights(spark, sf_dir):
    given = F.expr("""struct(cast(user_id % 3 as double) as sbert, cast(event_id % 2 as double) as desc,
        cast(event_id % 5 as double) / 2 as marca, cast(0 as double) as medida)""")
    events = t.table(spark, sf_dir, "events").select("event_id", given.alias("weights"))
    scaled = ranking.normalize_weights(events)
    return scaled.select("event_id", *[
        F.round(F.col("weights").getField(n), 6).alias(n) for n in WEIGHTS])


@register(q.with_(WEIGHTED, then="""SELECT query_id, cd_insumo, round(w_sbert, 6) AS sbert, round(w_desc, 6) AS "desc",
    round(w_marca, 6) AS marca, round(w_medida, 6) AS medida FROM weighted"""))
def effective_weights(spark, sf_dir):
    weighted = ranking.effective_weights(given_pairs(spark, sf_dir), WEIGHTS)
    return weighted.select("query_id", "cd_insumo", *[
        F.round(F.col("weights").getField(n), 6).alias(n) for n in WEIGHTS])


@register(q.with_(WEIGHTED, then="SELECT query_id, cd_insumo, round(score, 6) AS score FROM weighted"))
def combine_score(spark, sf_dir):
    return rounded(scored_pairs(spark, sf_dir).select("query_id", "cd_insumo", "score"), "score")


@register(q.with_(WEIGHTED, then=f"SELECT query_id, cd_insumo, round(score, 6) AS score FROM weighted WHERE score >= {THRESHOLD}"))
def filter_threshold(spark, sf_dir):
    kept = ranking.filter_threshold(scored_pairs(spark, sf_dir), THRESHOLD)
    return rounded(kept.select("query_id", "cd_insumo", "score"), "score")


@register(q.with_(t.QUERIES_SQL, then=f"SELECT query_id, marca FROM q0 WHERE {q.no_brand('marca')}"))
def filter_blank(spark, sf_dir):
    return ranking.filter_blank(t.catalog_queries(spark, sf_dir), "marca", brand=True).select("query_id", "marca")


@register(q.with_(RANKED, then="SELECT query_id, cd_insumo, round(score, 6) AS score, rank FROM ranked"))
def rank_matches(spark, sf_dir):
    ranked = ranking.rank_matches(scored_pairs(spark, sf_dir), THRESHOLD)
    return rounded(ranked.select("query_id", "cd_insumo", "score", "rank"), "score")


# ---- search and its quality ----

def shown(results: DataFrame) -> DataFrame:
    return rounded(results, *SIM_NAMES, "score").select(
        "query_id", "cd_insumo", "grp_insumo", "insumo_descricao", "marca", "medida", "status", "consulta",
        "score_sbert", *SIM_NAMES, "score", "rank")


@register(q.with_(RANKED, then=RESULT))
def hybrid_search(spark, sf_dir):
    return shown(search_given(spark, sf_dir))


@register(q.with_(RANKED, then=RESULT + " WHERE upper(d.status) = 'AT'"))
def filter_active(spark, sf_dir):
    return shown(ranking.filter_active(search_given(spark, sf_dir)))


TEXT_SEARCH = ", ".join([
    CATALOG,
    q.hash_vectors("hv", "SELECT cd_insumo, insumo_descricao || ' ' || marca || ' ' || medida AS txt FROM processed", "cd_insumo"),
    q.hash_vectors("hq", "SELECT query_id, trim(descricao || ' ' || marca || ' ' || medida) AS txt FROM q", "query_id"),
    q.knn_ctes("hq", "hv", K), q.sims_ctes(PAIRS.format(knn="knn")), q.weight_ctes(), q.ranked_cte(50.0),
])


@register(q.with_(TEXT_SEARCH, then=RESULT))
def hybrid_search_text(spark, sf_dir):
    """The whole way from text: default encoder, weights, neighbours and threshold."""
    raw = t.catalog_raw(spark, sf_dir)
    done = standardize_catalog(raw)
    items = embed.embed_hash(st.compose_embed_text(done.processed))
    return shown(search(
        t.catalog_queries(spark, sf_dir), items, done.display, st.unit_map_distinct(raw), encoder=embed.embed_hash))


@register(q.with_(RANKED, then=RESULT))
def export_results(spark, sf_dir):
    path = shared_dir(spark, "export")
    results = shown(search_given(spark, sf_dir))
    writers.export_results(results, path)
    stored = spark.read.schema(results.schema).csv(path, header=True, escape='"')
    return stored.fillna({"insumo_descricao": "", "marca": "", "medida": "", "consulta": ""})


GOLD = "gold AS (SELECT vec_id AS query_id, vec_id AS expected_cd_insumo FROM embeddings)"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-item gold set: each mixed query expects the item it was made from."""
    return t.item_vectors(spark, sf_dir).select(
        F.col("cd_insumo").alias("query_id"), F.col("cd_insumo").alias("expected_cd_insumo"))


@register(f"""WITH {t.QUERIES_SQL} SELECT descricao AS query_descricao, coalesce(marca, '') AS query_marca,
    coalesce(medida, '') AS query_medida, CASE WHEN query_id % 3 = 0 THEN NULL ELSE query_id END AS expected_cd_insumo FROM q0""")
def scan_gold(spark, sf_dir):
    path = shared_dir(spark, "gold")
    t.catalog_queries(spark, sf_dir).select(
        F.col("descricao").alias("query_descricao"), F.col("marca").alias("query_marca"),
        F.col("medida").alias("query_medida"),
        F.when(F.col("query_id") % 3 != 0, F.col("query_id")).alias("expected_cd_insumo"),
    ).write.csv(path, header=True, escape='"', **writers.KEEP_BLANKS)
    return readers.scan_gold(spark, path).fillna({"query_marca": "", "query_medida": ""})


@register(q.with_(RANKED, GOLD, then="""SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall
    FROM gold LEFT JOIN ranked ON gold.query_id = ranked.query_id AND expected_cd_insumo = cd_insumo"""))
def recall_at_k(spark, sf_dir):
    return rounded(metrics.recall_at_k(gold(spark, sf_dir), search_given(spark, sf_dir), k=1), "recall")


@register(q.with_(RANKED, GOLD, then="""SELECT round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6) AS mrr
    FROM gold LEFT JOIN ranked ON gold.query_id = ranked.query_id AND expected_cd_insumo = cd_insumo"""))
def mrr(spark, sf_dir):
    return rounded(metrics.mrr(gold(spark, sf_dir), search_given(spark, sf_dir)), "mrr")
