"""Registered queries: catalog sources, standardization, joins, sets and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.operators import sets
from catalogmatch.operators import standardize as st
from catalogmatch.plans.standardization import standardize_catalog as standardize
from catalogmatch.registered import sql as q
from catalogmatch.registered import tables as t
from catalogmatch.registered.registry import register
from catalogmatch.session import shared_dir
from catalogmatch.sources import readers, writers

RAW, CATALOG = t.RAW_SQL, q.catalog_ctes()
RAW_COLUMNS = ", ".join(t.RAW_RULES)
PROCESSED_COLUMNS = "grp_insumo, cd_insumo, insumo_descricao, marca, medida"
DISPLAY_COLUMNS = PROCESSED_COLUMNS + ", status"
STORED_UNITS = "stored AS (SELECT cd_medida, upper(medida) AS medida FROM units WHERE cd_medida <> 'KG' OR cd_medida IS NULL)"


def stored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit map that fell behind: the kilogram is missing."""
    units = st.unit_map_distinct(t.catalog_raw(spark, sf_dir))
    return units.where((F.col("cd_medida") != "KG") | F.col("cd_medida").isNull())


# ---- sources and sinks ----

@register(q.with_(RAW, then=f"SELECT {RAW_COLUMNS} FROM raw"))
def scan_catalog(spark, sf_dir):
    path = shared_dir(spark, "raw")
    writers.sink_append(t.catalog_raw(spark, sf_dir), path)
    return readers.scan_catalog(spark, path)


@register(q.with_(RAW, then=f"SELECT {RAW_COLUMNS} FROM raw"))
def scan_catalog_csv(spark, sf_dir):
    path = shared_dir(spark, "csv")
    t.catalog_raw(spark, sf_dir).write.csv(path, header=True, escape='"', **writers.KEEP_BLANKS)
    return readers.scan_catalog_csv(spark, path)


@register("SELECT vec_id AS cd_insumo FROM embeddings")
def scan_ids(spark, sf_dir):
    return readers.scan_ids(t.item_vectors(spark, sf_dir))


@register(q.with_(RAW, CATALOG, then=f"SELECT {DISPLAY_COLUMNS} FROM display"))
def scan_display(spark, sf_dir):
    display = standardize(t.catalog_raw(spark, sf_dir)).display
    return readers.scan_display(display.withColumn("updated_at", F.current_timestamp()))


@register(q.with_(RAW, CATALOG, then=f"""SELECT {PROCESSED_COLUMNS}, {q.digest('embedding')} AS digest
    FROM processed JOIN embeddings ON cd_insumo = vec_id"""))
def scan_items_with_vectors(spark, sf_dir):
    processed = standardize(t.catalog_raw(spark, sf_dir)).processed
    items = readers.scan_items_with_vectors(processed, t.item_vectors(spark, sf_dir))
    return items.withColumn("digest", vector_digest("vector")).drop("vector")


@register(q.with_(RAW, CATALOG, then=f"""SELECT {PROCESSED_COLUMNS}, {q.digest('embedding')} AS digest
    FROM processed JOIN embeddings ON cd_insumo = vec_id WHERE cd_insumo IN (SELECT l_partkey FROM lineitem)"""))
def scan_items_by_ids(spark, sf_dir):
    processed = standardize(t.catalog_raw(spark, sf_dir)).processed
    ids = t.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cd_insumo"))
    items = readers.scan_items_by_ids(processed, t.item_vectors(spark, sf_dir), ids)
    return items.withColumn("digest", vector_digest("vector")).drop("vector")


def vector_digest(col: str):
    return F.array_join(
        F.transform(col, lambda x: F.round(x.cast("double") * 10000).cast("int").cast("string")), ",")


@register(f"SELECT vec_id AS cd_insumo, {q.digest('embedding')} AS digest, len(embedding) AS dim FROM embeddings")
def vector_from_json(spark, sf_dir):
    stored = readers.vector_to_json(t.item_vectors(spark, sf_dir)).drop("vector")
    parsed = readers.vector_from_json(stored, "vector_json")
    return parsed.select("cd_insumo", vector_digest("vector").alias("digest"), F.size("vector").cast("bigint").alias("dim"))


@register("""SELECT vec_id AS cd_insumo, len(embedding) AS commas,
    round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings""")
def vector_to_json(spark, sf_dir):
    stored = readers.vector_to_json(t.item_vectors(spark, sf_dir))
    numbers = F.transform(F.split(F.translate("vector_json", "[]", ""), ","), lambda x: x.cast("double"))
    return stored.select(
        "cd_insumo", F.size(numbers).cast("bigint").alias("commas"),
        F.round(F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"))


@register(q.with_(RAW, CATALOG, then=f"SELECT {DISPLAY_COLUMNS} FROM display UNION ALL SELECT {DISPLAY_COLUMNS} FROM display"))
def sink_append(spark, sf_dir):
    path = shared_dir(spark, "append")
    display = standardize(t.catalog_raw(spark, sf_dir)).display
    writers.sink_append(display, path)
    writers.sink_append(display.where(F.lit(False)), path)
    writers.sink_append(display, path)
    return spark.read.parquet(path)


@register(f"""SELECT vec_id AS cd_insumo, {q.digest('embedding')} AS digest, 'given' AS model_name, 64 AS embedding_dim,
    (SELECT count(*) FROM embeddings) AS written FROM embeddings""")
def sink_vectors_checked(spark, sf_dir):
    path = shared_dir(spark, "vectors")
    written = writers.sink_vectors_checked(t.item_vectors(spark, sf_dir), path, "given", 64)
    return spark.read.parquet(path).select(
        "cd_insumo", vector_digest("vector").alias("digest"), "model_name", "embedding_dim",
        F.lit(written).cast("bigint").alias("written"))


@register(q.with_(RAW, then="SELECT DISTINCT cd_medida, medida FROM raw"))
def sink_replace_small(spark, sf_dir):
    path = shared_dir(spark, "units")
    writers.sink_replace_small(stored_units(spark, sf_dir), path)
    writers.sink_replace_small(st.unit_map_distinct(t.catalog_raw(spark, sf_dir)), path)
    return readers.read_small(spark, path)


@register(q.with_(RAW, t.FEEDBACK_SQL, then="""SELECT 'catalog_display' AS store, count(*) AS n FROM raw WHERE insumo IS NOT NULL
    UNION ALL SELECT 'catalog_processed', count(*) FROM raw WHERE insumo IS NOT NULL
    UNION ALL SELECT 'item_vectors', count(*) FROM embeddings
    UNION ALL SELECT 'unit_map', count(*) FROM (SELECT DISTINCT cd_medida, medida FROM raw)
    UNION ALL SELECT 'feedback', count(*) FROM feedback"""))
def ensure_tables(spark, sf_dir):
    folder = shared_dir(spark, "tables")
    database = folder.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    for _ in range(2):
        names = writers.ensure_tables(spark, database)
    done = standardize(t.catalog_raw(spark, sf_dir))
    now = F.current_timestamp()
    rows = {
        "catalog_display": done.display.withColumn("updated_at", now),
        "catalog_processed": done.processed.withColumn("updated_at", now),
        "item_vectors": writers.stamp_vectors(t.item_vectors(spark, sf_dir), "given", 64),
        "unit_map": st.unit_map_distinct(t.catalog_raw(spark, sf_dir)),
        "feedback": readers.flatten_feedback(t.feedback_nested(spark, sf_dir)),
    }
    counts = None
    for name in names:
        store = name.split(".")[1]
        writers.sink_append(rows[store], name)
        one = spark.table(name).agg(F.count("*").alias("n")).select(F.lit(store).alias("store"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


# ---- projections ----

@register(q.with_(RAW, then="""SELECT cd_insumo, coalesce(descricao, '') AS descricao, coalesce(marca, 'SEM MARCA') AS marca,
    coalesce(embalagem, '') AS embalagem, coalesce(qtd_medida, '') AS qtd_medida FROM raw"""))
def fill_defaults(spark, sf_dir):
    return st.fill_defaults(t.catalog_raw(spark, sf_dir)).select(
        "cd_insumo", "descricao", "marca", "embalagem", "qtd_medida")


@register(q.with_(RAW, CATALOG, then="SELECT grp_insumo, cd_insumo, medida_pad, insumo_descricao, medida_abv FROM composed"))
def compose_item_fields(spark, sf_dir):
    return st.compose_item_fields(st.fill_defaults(t.catalog_raw(spark, sf_dir))).select(
        "grp_insumo", "cd_insumo", "medida_pad", "insumo_descricao", "medida_abv")


@register(q.with_(RAW, CATALOG, then=f"SELECT {DISPLAY_COLUMNS} FROM display"))
def project_display(spark, sf_dir):
    return standardize(t.catalog_raw(spark, sf_dir)).display


@register(q.with_(RAW, CATALOG, then=f"SELECT {PROCESSED_COLUMNS} FROM projected"))
def project_processed(spark, sf_dir):
    usable, _ = st.split_rejects(t.catalog_raw(spark, sf_dir))
    return st.project_processed(st.compose_item_fields(st.fill_defaults(usable)))


@register(q.with_(RAW, CATALOG, then=f"SELECT {PROCESSED_COLUMNS} FROM processed"))
def standardize_catalog(spark, sf_dir):
    return standardize(t.catalog_raw(spark, sf_dir)).processed


@register(q.with_(RAW, t.UNITS_SQL, t.QUERIES_SQL, q.query_ctes(), then="SELECT query_id, consulta, descricao, marca, medida FROM q"))
def standardize_queries(spark, sf_dir):
    units = st.unit_map_distinct(t.catalog_raw(spark, sf_dir))
    return st.standardize_queries(t.catalog_queries(spark, sf_dir), units).select(
        "query_id", "consulta", "descricao", "marca", "medida")


@register(q.with_(RAW, CATALOG, then="""SELECT cd_insumo, insumo_descricao || ' ' || marca || ' ' || medida AS embed_text FROM processed"""))
def compose_embed_text(spark, sf_dir):
    return st.compose_embed_text(standardize(t.catalog_raw(spark, sf_dir)).processed).select("cd_insumo", "embed_text")


@register(q.with_(RAW, t.UNITS_SQL, t.QUERIES_SQL, q.query_ctes(), then="""SELECT query_id,
    trim(descricao || ' ' || marca || ' ' || medida) AS embed_text FROM q"""))
def compose_query_text(spark, sf_dir):
    units = st.unit_map_distinct(t.catalog_raw(spark, sf_dir))
    folded = st.standardize_queries(t.catalog_queries(spark, sf_dir), units)
    return st.compose_query_text(folded).select("query_id", "embed_text")


@register(q.with_(RAW, then=f"SELECT {RAW_COLUMNS} FROM raw"))
def drop_index_columns(spark, sf_dir):
    raw = t.catalog_raw(spark, sf_dir)
    return st.drop_index_columns(raw.withColumn("Unnamed: 0", F.col("cd_insumo")).withColumn("Unnamed: 1", F.lit(1)))


@register(q.with_(RAW, then="SELECT cd_insumo, grp_insumo FROM raw WHERE insumo IS NULL"))
def split_rejects(spark, sf_dir):
    return st.split_rejects(t.catalog_raw(spark, sf_dir))[1].select("cd_insumo", "grp_insumo")


# ---- joins and sets ----

@register(q.with_(RAW, then=f"SELECT {RAW_COLUMNS} FROM raw WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = cd_insumo)"))
def new_items(spark, sf_dir):
    return sets.new_items(t.catalog_raw(spark, sf_dir), t.item_vectors(spark, sf_dir))


@register("SELECT vec_id AS cd_insumo FROM embeddings WHERE vec_id NOT IN (SELECT l_partkey FROM lineitem)")
def missing_local(spark, sf_dir):
    cache = t.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cd_insumo"))
    return sets.missing_local(t.item_vectors(spark, sf_dir), cache)


@register(q.with_(RAW, then=f"SELECT cd_insumo, insumo, {q.digest('embedding')} AS digest FROM raw JOIN embeddings ON vec_id = cd_insumo"))
def join_vectors(spark, sf_dir):
    joined = sets.join_vectors(t.catalog_raw(spark, sf_dir), t.item_vectors(spark, sf_dir))
    return joined.select("cd_insumo", "insumo", vector_digest("vector").alias("digest"))


@register(q.with_(RAW, t.UNITS_SQL, t.QUERIES_SQL, q.expanded_ctes(), then="SELECT query_id, medida FROM expanded"))
def expand_measure(spark, sf_dir):
    units = st.unit_map_distinct(t.catalog_raw(spark, sf_dir))
    queries = t.catalog_queries(spark, sf_dir).withColumn(
        "medida", F.when(F.trim(F.coalesce("medida", F.lit(""))) == "", "").otherwise(F.col("medida")))
    return st.expand_measure(queries, units, "medida").select("query_id", "medida")


@register(q.with_(RAW, CATALOG, then="""SELECT d.grp_insumo, d.cd_insumo, d.insumo_descricao, d.marca, d.medida, d.status,
    p.insumo_descricao AS proc_descricao, p.marca AS proc_marca, p.medida AS proc_medida
    FROM display d JOIN processed p ON d.cd_insumo = p.cd_insumo"""))
def align_display_processed(spark, sf_dir):
    done = standardize(t.catalog_raw(spark, sf_dir))
    return sets.align_display_processed(done.display, done.processed)


@register(q.with_(RAW, CATALOG, then=f"""SELECT {DISPLAY_COLUMNS} FROM display
    WHERE cd_insumo NOT IN (SELECT vec_id FROM embeddings)"""))
def seed_diff(spark, sf_dir):
    done = standardize(t.catalog_raw(spark, sf_dir))
    _, display = sets.seed_diff(done.processed, t.item_vectors(spark, sf_dir), done.display)
    return display


@register(q.with_(RAW, CATALOG, then=f"""SELECT {PROCESSED_COLUMNS}, NULL::VARCHAR AS status FROM processed
    UNION ALL SELECT {DISPLAY_COLUMNS} FROM display"""))
def union_append(spark, sf_dir):
    done = standardize(t.catalog_raw(spark, sf_dir))
    return sets.union_append(done.processed, done.display)


@register(q.with_(RAW, then="""SELECT DISTINCT cd_insumo FROM raw WHERE cd_insumo NOT IN (SELECT vec_id FROM embeddings)"""))
def ids_except(spark, sf_dir):
    return sets.ids_except(t.catalog_raw(spark, sf_dir), t.item_vectors(spark, sf_dir))


@register(q.with_(RAW, t.UNITS_SQL, then="SELECT cd_medida, medida FROM units"))
def unit_map_distinct(spark, sf_dir):
    return st.unit_map_distinct(t.catalog_raw(spark, sf_dir))


@register(q.with_(RAW, t.UNITS_SQL, then="""SELECT cd_medida, medida, 'added' AS change FROM units WHERE cd_medida = 'KG'
    UNION ALL SELECT 'UN', 'UNIDADE', 'removed'"""))
def unit_map_diff(spark, sf_dir):
    current = st.unit_map_distinct(t.catalog_raw(spark, sf_dir))
    stale = current.where("cd_medida = 'KG'").select(F.lit("UN").alias("cd_medida"), F.lit("UNIDADE").alias("medida"))
    return sets.unit_map_diff(current, stored_units(spark, sf_dir).unionByName(stale))


@register(q.with_(RAW, t.UNITS_SQL, STORED_UNITS, then="""SELECT (SELECT count(DISTINCT cd_medida || '|' || medida) FROM raw)
    - (SELECT count(*) FROM stored) AS drift"""))
def unit_map_drift_count(spark, sf_dir):
    return sets.unit_map_drift_count(t.catalog_raw(spark, sf_dir), stored_units(spark, sf_dir))


@register("SELECT (SELECT count(*) FROM part) AS n_raw, (SELECT count(*) FROM embeddings) AS n_encoded")
def count_totals(spark, sf_dir):
    return sets.count_totals(t.catalog_raw(spark, sf_dir), t.item_vectors(spark, sf_dir))


@register(q.with_(RAW, then=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM raw" for c in t.RAW_RULES)))
def null_profile(spark, sf_dir):
    return sets.null_profile(t.catalog_raw(spark, sf_dir))


@register(q.with_(RAW, then=f"SELECT {RAW_COLUMNS} FROM raw ORDER BY md5(cast(cd_insumo AS varchar) || '-0'), cd_insumo LIMIT 10"))
def catalog_sample(spark, sf_dir):
    return sets.catalog_sample(t.catalog_raw(spark, sf_dir))


# ---- text and measures ----

@register(f"SELECT doc_id, {q.fold('text')} AS text FROM documents")
def fold_text(spark, sf_dir):
    return st.fold_text(t.table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@register(f"SELECT doc_id, {q.stop(q.fold('text'))} AS text FROM documents")
def remove_stopwords(spark, sf_dir):
    folded = st.fold_text(t.table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])
    return st.remove_stopwords(folded, ["text"])


@register("""WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM
        (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)),
    f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY ALL)
    SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS text FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def dedupe_words(spark, sf_dir):
    return st.dedupe_words(t.table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@register(q.with_(RAW, then="SELECT cd_insumo, replace(grp_insumo, '.0', '') AS grp_insumo, replace(qtd_medida, '.0', '') AS qtd_medida FROM raw"))
def strip_dot_zero(spark, sf_dir):
    raw = t.catalog_raw(spark, sf_dir).select("cd_insumo", "grp_insumo", "qtd_medida")
    return st.strip_dot_zero(raw, ["grp_insumo", "qtd_medida"])


MEASURES = """SELECT cd_insumo, qtd_medida || ' ' || coalesce(medida, '') || ' x' AS medida FROM raw
    UNION ALL SELECT l_orderkey * 10 + l_linenumber, cast(l_quantity AS varchar) || ' ' || ({units}) FROM lineitem"""
LINE_UNITS = """case l_suppkey % 6 when 0 then 'MILIGRAMA' when 1 then 'TONELADA' when 2 then 'METRO CUBICO'
    when 3 then 'Pés' when 4 then 'kilometro' else 'JARDAS' end"""


def measure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.catalog_raw(spark, sf_dir).selectExpr(
        "cd_insumo", "qtd_medida || ' ' || coalesce(medida, '') || ' x' AS medida")
    lines = t.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS cd_insumo", f"cast(l_quantity AS string) || ' ' || ({LINE_UNITS}) AS medida")
    return raw.unionByName(lines)


@register(q.with_(RAW, f"m AS ({MEASURES.format(units=LINE_UNITS)})", then=f"SELECT cd_insumo, {q.convert('medida')} AS medida FROM m"))
def standardize_measures(spark, sf_dir):
    return st.standardize_measures(measure_texts(spark, sf_dir), ["medida"])


@register(q.with_(RAW, CATALOG, then=f"""SELECT cd_insumo, medida, {q.parsed_value('medida')} AS medida_value,
    {q.parsed_unit('medida')} AS medida_unit FROM display"""))
def parse_measures(spark, sf_dir):
    display = standardize(t.catalog_raw(spark, sf_dir)).display.select("cd_insumo", "medida")
    return st.parse_measures(display, "medida")
