"""Domain tables derived from the driver's tables.

The rules are plain SQL expressions that Spark and DuckDB read alike, so each rule is written
once.  All rows of the driver's tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.session import spread

PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]  # what the rules on ``part`` read

RAW_RULES = {
    "grp_insumo": "cast(p_partkey % 12 as string) || case when p_partkey % 3 = 0 then '.0' else '' end",
    "cd_insumo": "p_partkey",
    "insumo": "case when p_partkey % 97 = 13 then null else upper(p_name) end",
    "descricao": """case p_partkey % 7
        when 0 then null
        when 1 then 'Peça de ' || p_name || ' não-galvanizada'
        when 2 then p_type || ' para construção, até 3 vezes'
        when 3 then lower(p_type) || ' com rosca e sem válvula ' || p_type
        else p_type || ' ' || p_brand end""",
    "marca": """case when p_partkey % 5 = 0 then null when p_partkey % 10 = 3 then 'SEM MARCA'
        when p_partkey % 10 = 6 then p_brand || ' Comércio do Brasil' else p_brand end""",
    "embalagem": "case when p_partkey % 4 = 0 then null else 'Caixa' end",
    "qtd_medida": """case when p_partkey % 11 = 0 then null else cast(p_size as string) ||
        case p_partkey % 6 when 0 then '.5' when 1 then '.0' when 2 then ',25' when 3 then '.05' else '' end end""",
    "cd_medida": """case p_partkey % 9 when 0 then 'KG' when 1 then 'G' when 2 then 'ML' when 3 then 'L'
        when 4 then 'M' when 5 then 'CM' when 6 then 'PC' when 7 then 'POL' else null end""",
    "medida": """case p_partkey % 9 when 0 then 'KILOGRAMA' when 1 then 'GRAMA' when 2 then 'MILILITRO'
        when 3 then 'LITRO' when 4 then 'METRO' when 5 then 'CENTIMETRO' when 6 then 'PACOTE'
        when 7 then 'POLEGADA' else null end""",
    "status": "case when p_partkey % 6 = 0 then 'IN' when p_partkey % 6 = 1 then 'at' else 'AT' end",
}

QUERY_RULES = {
    "query_id": "p_partkey",
    "descricao": """case p_partkey % 4 when 0 then upper(p_name) || ' de construção'
        when 1 then p_name || ' ' || p_type when 2 then ' ' || p_type || ' para ' || p_name
        else p_name || ' com rosca' end""",
    "marca": """case p_partkey % 6 when 0 then '' when 1 then null when 2 then 'Sem Marca '
        when 3 then p_brand || ' Comércio' else p_brand end""",
    "medida": """case p_partkey % 8 when 0 then '' when 1 then null when 2 then '2,5KG'
        when 3 then cast(p_size as string) || 'pacote azul'
        else cast(p_size as string) || ' ' || case p_partkey % 5 when 0 then 'kg' when 1 then 'G'
        when 2 then 'ml' when 3 then 'M' else 'pol' end end""",
}

FEEDBACK_RULES = {
    "feedback_id": "cast(event_id as string)",
    "timestamp_utc": "ts",
    "session_id": "'s' || cast(user_id as string)",
    "user_descricao": """case when user_id % 3 = 0 then 'item ' || cast(event_id % 400 as string) || '  '
        when event_id % 400 = 7 then null else 'Item ' || cast(event_id % 400 as string) end""",
    "user_marca": """case when event_id % 5 = 0 then null when event_id % 8 = 3 then 'a|b'
        else 'Brand#' || cast(event_id % 25 as string) end""",
    "user_medida": "case when event_id % 4 = 0 then null else cast(event_id % 50 as string) || ' kg' end",
    "match_cd_insumo": "(event_id % 400) * 5 + user_id % 3",
    "match_grp_insumo": "cast(event_id % 12 as string)",
    "match_descricao": "'ITEM ' || cast((event_id % 400) * 5 + user_id % 3 as string)",
    "match_marca": "'Brand#' || cast(user_id % 25 as string)",
    "match_medida": "cast(event_id % 50 as string) || ' KG'",
    "match_status": "case when event_id % 6 = 0 then 'IN' else 'AT' end",
    "score_sbert": "value / (value + 50)",
    "score_desc_tokens": "cast(event_id % 101 as double) / 100",
    "score_marca_tokens": "cast(user_id % 11 as double) / 10",
    "score_medida_num": "cast(event_id % 7 as double) / 8",
    "score_final": "100 * value / (value + 40)",
    "rank_posicao": "case when event_id % 31 = 0 then null else cast(1 + user_id % 5 as int) end",
    "label": """case event_type when 'purchase' then 1 when 'click' then 1 when 'view' then 0
        when 'error' then 0 else null end""",
    "app_version": "'v2'",
    "knn_k": "30",
}
SNAPSHOT_SQL = """'{"desc":0.0,"marca":0.25,"medida":' || case when event_id % 2 = 0 then '0.25' else '0.5' end || ',"sbert":0.5}'"""


def _select(rules: dict[str, str]) -> list[str]:
    return [f"{rule} AS {name}" for name, rule in rules.items()]


def _cte(name: str, rules: dict[str, str], table: str) -> str:
    return f"{name} AS (SELECT {', '.join(_select(rules))} FROM {table})"


RAW_SQL = _cte("raw", RAW_RULES, "part")
QUERIES_SQL = _cte("q0", QUERY_RULES, "part")
FEEDBACK_SQL = _cte("feedback", FEEDBACK_RULES, "events")
UNITS_SQL = "units AS (SELECT DISTINCT cd_medida, medida FROM raw)"
QUERY_VECTORS_SQL = """qv AS (SELECT a.vec_id AS query_id,
    list_transform(range(1, len(a.embedding) + 1), lambda i:
        CAST(CAST(0.4 AS DOUBLE) * CAST(a.embedding[i] AS DOUBLE)
           + CAST(0.6 AS DOUBLE) * CAST(coalesce(b.embedding, a.embedding)[i] AS DOUBLE) AS FLOAT)) AS vector
    FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(PART_COLUMNS)).selectExpr(*_select(RAW_RULES))


def catalog_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(PART_COLUMNS)).selectExpr(*_select(QUERY_RULES))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cd_insumo"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector mixed with its successor, so the expected item is never the nearest by far."""
    own = item_vectors(spark, sf_dir)
    following = own.select((F.col("cd_insumo") - 1).alias("cd_insumo"), F.col("vector").alias("next"))
    mixed = F.zip_with(
        "vector", F.coalesce("next", "vector"),
        lambda x, y: (0.4 * x.cast("double") + 0.6 * y.cast("double")).cast("float"))
    return own.join(following, "cd_insumo", "left").select(
        F.col("cd_insumo").alias("query_id"), mixed.alias("vector"))


def feedback(spark: SparkSession, sf_dir: str, snapshot: bool = False) -> DataFrame:
    """Feedback from all events; sign-ups stand for votes without a label."""
    return feedback_from_events(table(spark, sf_dir, "events"), snapshot)


def feedback_from_events(events: DataFrame, snapshot: bool = False) -> DataFrame:
    extra = ["event_id AS _event"] if snapshot else []
    flat = events.selectExpr(*_select(FEEDBACK_RULES), *extra).withColumn(
        "timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    if not snapshot:
        return flat
    medida = F.when(F.col("_event") % 2 == 0, 0.25).otherwise(0.5)
    return flat.withColumn("weights_snapshot", F.create_map(
        F.lit("desc"), F.lit(0.0), F.lit("marca"), F.lit(0.25), F.lit("medida"), medida,
        F.lit("sbert"), F.lit(0.5))).drop("_event")


def feedback_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same votes as nested records."""
    flat = feedback(spark, sf_dir, snapshot=True)
    user = F.struct(*[F.col(f"user_{n}").alias(n) for n in ("descricao", "marca", "medida")])
    match = F.struct(*[F.col(f"match_{n}").alias(n)
                       for n in ("cd_insumo", "grp_insumo", "descricao", "marca", "medida", "status")])
    scores = F.struct(
        F.col("score_sbert").alias("sbert"), F.col("score_desc_tokens").alias("desc_tokens"),
        F.col("score_marca_tokens").alias("marca_tokens"),
        F.col("score_medida_num").alias("medida_numeric"), F.col("score_final").alias("final"))
    return flat.select(
        "feedback_id", F.col("timestamp_utc").alias("timestamp"), "session_id",
        user.alias("user_input"), match.alias("match"), scores.alias("scores"),
        F.col("rank_posicao").alias("rank"), "label", "app_version", "knn_k", "weights_snapshot")
