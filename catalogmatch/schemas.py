"""Declared schemas and default parameters of the catalog domain."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: default score weights, threshold, neighbours, model and feedback goals ----
DEFAULT_WEIGHTS = {"sbert": 0.5, "desc": 0.0, "marca": 0.25, "medida": 0.25}
DEFAULT_THRESHOLD = 50.0
DEFAULT_NEIGHBOURS = 30
DEFAULT_MODEL = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"
DEFAULT_DIM = 384
ENCODE_BATCH = 64
NO_BRAND = "SEM MARCA"
NO_BRAND_TEXTS = ("", "sem marca")
GOAL_VALIDATIONS = 1000
GOAL_QUERIES = 300
GOAL_VALIDATIONS_PER_QUERY = 3
# ---- end of fixed values ----

WEIGHT_FIELDS = tuple(DEFAULT_WEIGHTS)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _L, _I, _D, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType(),
)
VECTOR = T.ArrayType(T.FloatType(), True)

CATALOG_RAW = _struct(
    grp_insumo=_S, cd_insumo=_L, insumo=_S, descricao=_S, marca=_S, embalagem=_S,
    qtd_medida=_S, cd_medida=_S, medida=_S, status=_S,
)

CATALOG_DISPLAY = _struct(
    grp_insumo=_S, cd_insumo=_L, insumo_descricao=_S, marca=_S, medida=_S, status=_S,
    updated_at=_TS,
)

CATALOG_PROCESSED = _struct(
    grp_insumo=_S, cd_insumo=_L, insumo_descricao=_S, marca=_S, medida=_S, updated_at=_TS,
)

ITEM_VECTORS = _struct(
    cd_insumo=_L, vector=VECTOR, model_name=_S, embedding_dim=_I, created_at=_TS,
)

ITEM_CACHE = _struct(
    grp_insumo=_S, cd_insumo=_L, insumo_descricao=_S, marca=_S, medida=_S, vector=VECTOR,
)

UNIT_MAP = _struct(cd_medida=_S, medida=_S)

FEEDBACK = _struct(
    feedback_id=_S, timestamp_utc=_TS, session_id=_S,
    user_descricao=_S, user_marca=_S, user_medida=_S,
    match_cd_insumo=_L, match_grp_insumo=_S, match_descricao=_S, match_marca=_S,
    match_medida=_S, match_status=_S,
    score_sbert=_D, score_desc_tokens=_D, score_marca_tokens=_D, score_medida_num=_D,
    score_final=_D,
    rank_posicao=_I, label=_I, app_version=_S, knn_k=_I, weights_snapshot=T.VariantType(),
)

FEEDBACK_NESTED = T.StructType([
    T.StructField("feedback_id", _S),
    T.StructField("timestamp", _TS),
    T.StructField("session_id", _S),
    T.StructField("user_input", _struct(descricao=_S, marca=_S, medida=_S)),
    T.StructField("match", _struct(
        cd_insumo=_L, grp_insumo=_S, descricao=_S, marca=_S, medida=_S, status=_S)),
    T.StructField("scores", _struct(
        sbert=_D, desc_tokens=_D, marca_tokens=_D, medida_numeric=_D, final=_D)),
    T.StructField("rank", _I),
    T.StructField("label", _I),
    T.StructField("app_version", _S),
    T.StructField("knn_k", _I),
    T.StructField("weights_snapshot", T.MapType(_S, _D)),
])

# ---- fixed values: flat stored name -> dotted name used when reading feedback back ----
FEEDBACK_READ_NAMES = {
    "timestamp_utc": "timestamp",
    "user_descricao": "user_input.descricao",
    "user_marca": "user_input.marca",
    "user_medida": "user_input.medida",
    "match_cd_insumo": "match.cd_insumo",
    "match_grp_insumo": "match.grp_insumo",
    "match_descricao": "match.descricao",
    "match_marca": "match.marca",
    "match_medida": "match.medida",
    "match_status": "match.status",
    "score_sbert": "scores.sbert",
    "score_desc_tokens": "scores.desc_tokens",
    "score_marca_tokens": "scores.marca_tokens",
    "score_medida_num": "scores.medida_numeric",
    "score_final": "scores.final",
    "rank_posicao": "rank",
}

GOLD = _struct(
    query_descricao=_S, query_marca=_S, query_medida=_S, expected_cd_insumo=_L,
)
