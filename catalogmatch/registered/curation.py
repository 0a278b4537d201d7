"""Registered queries: training-data curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.operators import agreement
from catalogmatch.operators import curation as cu
from catalogmatch.registered import tables as t
from catalogmatch.registered.registry import register

TIME = "%Y-%m-%d %H:%M:%S.%f"
KEYS = "key_descricao, key_marca, key_medida"
PAIR = f"{KEYS}, match_cd_insumo"
WITH = f"""WITH {t.FEEDBACK_SQL}, keys AS (SELECT *, upper(trim(coalesce(user_descricao, ''))) AS key_descricao,
    upper(trim(coalesce(user_marca, ''))) AS key_marca, upper(trim(coalesce(user_medida, ''))) AS key_medida,
    coalesce(label = 1, false) AS yes, CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS variant
    FROM feedback)"""
LAST = f"""latest AS (SELECT * FROM keys QUALIFY row_number() OVER (
    PARTITION BY {PAIR} ORDER BY timestamp_utc DESC, feedback_id DESC, session_id DESC) = 1)"""
PER_SESSION = f"""session_votes AS (SELECT * FROM keys QUALIFY row_number() OVER (
    PARTITION BY {PAIR}, session_id ORDER BY timestamp_utc DESC, feedback_id DESC) = 1),
    totals AS (SELECT {PAIR}, count(*) AS sessions, count(*) FILTER (yes) AS approved FROM session_votes GROUP BY ALL)"""


def digits(e: str) -> str:
    """The first four hex digits of the MD5 of a text as a number."""
    return " + ".join(f"(instr('0123456789abcdef', substr(md5({e}), {i + 1}, 1)) - 1) * {16 ** (3 - i)}" for i in range(4))


def split(e: str) -> str:
    return f"CASE WHEN ({digits(e)}) % 100 < 80 THEN 'train' ELSE 'test' END"


def feedback(spark, sf_dir) -> DataFrame:
    return t.feedback(spark, sf_dir)


def by_variant(spark, sf_dir) -> DataFrame:
    """Votes with a variant: sessions of even users against those of odd ones."""
    even = F.substring("session_id", 2, 20).cast("long") % 2 == 0
    return feedback(spark, sf_dir).withColumn("variant", F.when(even, "even").otherwise("odd"))


def printable(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register(f"""{WITH} SELECT count(*) FILTER (yes) AS approved, count(*) FILTER (NOT yes) AS rejected,
    round(count(*) FILTER (yes)::DOUBLE / nullif(count(*) FILTER (NOT yes), 0), 6) AS ratio FROM keys""")
def label_distribution(spark, sf_dir):
    return rounded(cu.label_distribution(feedback(spark, sf_dir)), "ratio")


@register(f"""{WITH} SELECT votes, count(*) AS queries FROM (SELECT count(*) AS votes FROM keys GROUP BY {KEYS}) GROUP BY votes""")
def votes_per_query_hist(spark, sf_dir):
    return cu.votes_per_query_hist(feedback(spark, sf_dir))


@register(f"""{WITH}, s AS (SELECT CASE WHEN yes THEN 'approved' ELSE 'rejected' END AS outcome, score_sbert AS s
        FROM keys WHERE score_sbert IS NOT NULL)
    SELECT outcome, count(*) AS votes, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS deviation, round(quantile_cont(s, 0.25), 6) AS q1,
    round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75), 6) AS q3 FROM s GROUP BY outcome""")
def score_by_label(spark, sf_dir):
    return rounded(cu.score_by_label(feedback(spark, sf_dir)), "mean", "deviation", "q1", "median", "q3")


@register(f"""{WITH} SELECT {PAIR}, count(*) FILTER (yes) AS approved, count(*) FILTER (NOT yes) AS rejected,
    count(DISTINCT session_id) AS sessions FROM keys GROUP BY ALL HAVING approved > 0 AND rejected > 0 AND sessions > 1""")
def contradictions(spark, sf_dir):
    return cu.contradictions(feedback(spark, sf_dir))


@register(f"""{WITH}, {LAST} SELECT {PAIR}, strftime(timestamp_utc, '{TIME}') AS timestamp_utc, feedback_id, session_id, label FROM latest""")
def latest_votes(spark, sf_dir):
    return printable(cu.latest_votes(feedback(spark, sf_dir)), "timestamp_utc")


@register(f"""{WITH}, {PER_SESSION} SELECT {PAIR}, sessions AS votes, approved, CASE WHEN 2 * approved > sessions THEN 'approved'
    WHEN 2 * approved < sessions THEN 'rejected' ELSE 'uncertain' END AS outcome FROM totals
    WHERE approved IN (0, sessions) OR sessions >= 3""")
def resolve_votes(spark, sf_dir):
    return cu.resolve_votes(feedback(spark, sf_dir))


@register(f"{WITH} SELECT feedback_id, key_descricao, {split('key_descricao')} AS split FROM keys")
def split_by_query(spark, sf_dir):
    return cu.split_by_query(feedback(spark, sf_dir)).select("feedback_id", "key_descricao", "split")


@register(f"""{WITH}, s AS (SELECT key_descricao, {split('feedback_id')} AS split FROM keys)
    SELECT key_descricao, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test
    FROM s GROUP BY 1 HAVING train > 0 AND test > 0""")
def leak_check(spark, sf_dir):
    return cu.leak_check(cu.split_by_vote(feedback(spark, sf_dir)))


@register(f"""{WITH}, ranked AS (SELECT feedback_id, yes, label, row_number() OVER (PARTITION BY yes ORDER BY md5(feedback_id), feedback_id) AS place
        FROM keys), quota AS (SELECT floor(1.5 * count(*) FILTER (NOT yes)) AS q FROM keys)
    SELECT feedback_id, label FROM ranked, quota WHERE NOT yes OR place <= q""")
def balance_classes(spark, sf_dir):
    return cu.balance_classes(feedback(spark, sf_dir)).select("feedback_id", "label")


@register(f"""{WITH}, {LAST} SELECT {PAIR}, strftime(timestamp_utc, '{TIME}') AS timestamp_utc, feedback_id, session_id, label,
    CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY latest.timestamp_utc DESC, match_cd_insumo) AS INTEGER) AS place
    FROM latest QUALIFY place <= 10""")
def cap_per_query(spark, sf_dir):
    return printable(cu.cap_per_query(feedback(spark, sf_dir)), "timestamp_utc")


def _mined(condition: str, weight: str, source: str) -> str:
    return f"""{WITH} SELECT {PAIR}, round(max(score_sbert), 6) AS score, {weight}::DOUBLE AS weight, '{source}' AS source FROM keys
        WHERE NOT yes AND rank_posicao <= 30 AND {condition} GROUP BY {PAIR}"""


def asked(spark, sf_dir) -> DataFrame:
    """A vector for every query that votes name: ``ITEM n`` asks with the query vector ``n``."""
    number = F.expr("try_cast(substring(key_descricao, 6) as bigint)")
    keys = cu.query_key(feedback(spark, sf_dir)).select(*cu.KEY).distinct().withColumn("query_id", number)
    return keys.join(t.query_vectors(spark, sf_dir), "query_id").select(*cu.KEY, "vector")


def _counted(condition: str, weight: str, source: str) -> str:
    """Rejected pairs with their rank among all items, each similarity computed."""
    return f"""{WITH}, {t.QUERY_VECTORS_SQL}, pairs AS (SELECT {PAIR}, try_cast(substr(key_descricao, 6) AS BIGINT) AS query_id, max(score_sbert) AS score
            FROM keys WHERE NOT yes AND {condition} GROUP BY ALL),
        asked AS (SELECT query_id, vector FROM qv SEMI JOIN pairs USING (query_id)),
        sims AS (SELECT query_id, vec_id AS cd_insumo, round(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 6) AS s FROM asked, embeddings),
        ranks AS (SELECT query_id, cd_insumo AS match_cd_insumo, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cd_insumo) AS knn_rank FROM sims)
        SELECT {PAIR}, round(score, 6) AS score, knn_rank, {weight}::DOUBLE AS weight, '{source}' AS source
        FROM pairs JOIN ranks USING (query_id, match_cd_insumo) WHERE knn_rank <= 30"""


HARD, SEMI_HARD = "score_sbert > 0.7::DOUBLE", "score_sbert BETWEEN 0.5::DOUBLE AND 0.7::DOUBLE"


@register(_counted(HARD, "2.0", "hard_negative"))
def hard_negatives(spark, sf_dir):
    return rounded(cu.hard_negatives(feedback(spark, sf_dir), asked(spark, sf_dir), t.item_vectors(spark, sf_dir)), "score")


@register(_counted(SEMI_HARD, "1.0", "semi_hard_negative"))
def semi_hard_negatives(spark, sf_dir):
    return rounded(cu.semi_hard_negatives(feedback(spark, sf_dir), asked(spark, sf_dir), t.item_vectors(spark, sf_dir)), "score")


@register(_mined(HARD, "2.0", "hard_negative"))
def hard_negatives_by_stored_rank(spark, sf_dir):
    return rounded(cu.hard_negatives(feedback(spark, sf_dir)), "score")


@register(_mined(SEMI_HARD, "1.0", "semi_hard_negative"))
def semi_hard_negatives_by_stored_rank(spark, sf_dir):
    return rounded(cu.semi_hard_negatives(feedback(spark, sf_dir)), "score")


REPORT = f"""queries AS (SELECT variant AS model, {KEYS}, min(rank_posicao) FILTER (yes) AS r, min(rank_posicao) AS a FROM keys GROUP BY ALL),
    ranked AS (SELECT model, count(*) AS queries, avg(coalesce(r <= 1, false)::INT) AS recall_1, avg(coalesce(r <= 5, false)::INT) AS recall_5,
        avg(coalesce(r <= 10, false)::INT) AS recall_10, avg(coalesce(1.0::DOUBLE / r, 0)) AS mrr, avg(coalesce(a <= 10, false)::INT) AS coverage_10
        FROM queries GROUP BY model),
    scores AS (SELECT variant AS model, avg(score_final) FILTER (yes) - avg(score_final) FILTER (NOT yes) AS separation FROM keys GROUP BY 1)"""
METRICS = ("recall_1", "recall_5", "recall_10", "mrr", "coverage_10")


@register(f"""{WITH}, {REPORT} SELECT model, queries, {', '.join(f'round({m}, 6) AS {m}' for m in (*METRICS, 'separation'))}
    FROM ranked JOIN scores USING (model)""")
def eval_report(spark, sf_dir):
    return rounded(cu.eval_report(by_variant(spark, sf_dir), "variant"), *METRICS, "separation")


@register(f"""{WITH}, {REPORT}, long AS ({' UNION ALL '.join(f"SELECT model, '{m}' AS metric, {m} AS v FROM ranked" for m in METRICS)}),
    side AS (SELECT metric, max(v) FILTER (model = 'even') AS base, max(v) FILTER (model = 'odd') AS candidate FROM long GROUP BY metric),
    points AS (SELECT *, round(100 * (candidate - base), 6) AS points FROM side)
    SELECT metric, round(base, 6) AS base, round(candidate, 6) AS candidate, points,
        (SELECT max(points) FILTER (metric = 'recall_5') >= 5 AND min(points) >= -2 FROM points) AS accepted FROM points""")
def compare_models(spark, sf_dir):
    report = cu.eval_report(by_variant(spark, sf_dir), "variant")
    return rounded(cu.compare_models(report, "even", "odd"), "base", "candidate")


@register(f"""{WITH} SELECT strftime(min(timestamp_utc), '{TIME}') AS first_vote, strftime(max(timestamp_utc), '{TIME}') AS last_vote,
    count(*) AS votes, (SELECT count(*) FROM (SELECT DISTINCT {PAIR} FROM keys)) AS pairs,
    (SELECT count(*) FROM (SELECT DISTINCT {KEYS} FROM keys)) AS queries, count(*) FILTER (yes) AS approved,
    round(count(*) FILTER (yes)::DOUBLE / count(*), 6) AS approved_share FROM keys""")
def training_manifest(spark, sf_dir):
    return rounded(printable(cu.training_manifest(feedback(spark, sf_dir)), "first_vote", "last_vote"), "approved_share")


@register(f"""{WITH}, c AS (SELECT variant, count(*) AS votes, count(*) FILTER (rank_posicao <= 5) AS top5,
        count(*) FILTER (rank_posicao <= 5 AND yes) AS top5_approved, round(avg(rank_posicao) FILTER (yes), 6) AS approved_rank FROM keys GROUP BY 1)
    SELECT *, round(100.0::DOUBLE * top5_approved / nullif(top5, 0), 6) AS approved_pct, votes >= 200 AS enough FROM c""")
def ab_summary(spark, sf_dir):
    return rounded(cu.ab_summary(by_variant(spark, sf_dir), "variant"), "approved_rank", "approved_pct")


@register(f"""{WITH}, c AS (SELECT variant, rank_posicao AS rank, count(*) AS votes, count(*) FILTER (yes) AS approved FROM keys GROUP BY ALL)
    SELECT *, round(100.0::DOUBLE * approved / nullif(sum(approved) OVER (PARTITION BY variant), 0), 6) AS approved_pct FROM c""")
def ab_ranks(spark, sf_dir):
    return rounded(cu.ab_ranks(by_variant(spark, sf_dir), "variant"), "approved_pct")


@register(f"""{WITH}, half AS (SELECT min(timestamp_utc) + (max(timestamp_utc) - min(timestamp_utc)) / 2 AS h FROM keys)
    SELECT count(*) FILTER (date_trunc('day', timestamp_utc) > date_trunc('day', h)) AS new_votes,
        count(*) FILTER (date_trunc('day', timestamp_utc) > date_trunc('day', h)) >= 500 AS retrain FROM keys, half""")
def retrain_trigger(spark, sf_dir):
    votes = feedback(spark, sf_dir)
    span = votes.agg(F.min("timestamp_utc").alias("a"), F.max("timestamp_utc").alias("b")).select(
        F.date_trunc("day", F.col("a") + (F.col("b") - F.col("a")) / 2).alias("h")).first()
    end_of_day = F.lit(span.h) + F.expr("interval 1 day") - F.expr("interval 1 microsecond") if span.h else F.lit(None).cast("timestamp")
    return cu.retrain_trigger(votes, end_of_day)


@register(f"""{WITH} SELECT strftime(date_trunc('day', timestamp_utc), '{TIME}') AS period, count(*) AS votes, count(*) FILTER (NOT yes) AS rejected,
    round(count(*) FILTER (NOT yes)::DOUBLE / count(*), 6) AS rejected_share FROM keys WHERE rank_posicao <= 3 GROUP BY 1""")
def rejects_top3_trend(spark, sf_dir):
    return rounded(printable(cu.rejects_top3_trend(feedback(spark, sf_dir)), "period"), "rejected_share")


@register(f"""{WITH}, asked AS (SELECT unnest(string_split_regex(key_descricao, '\\s+')) AS word FROM keys),
    known AS (SELECT DISTINCT unnest(string_split_regex(upper(coalesce(p_name, '')), '\\s+')) AS word FROM part)
    SELECT word, count(*) AS uses FROM asked WHERE word <> '' AND word NOT IN (SELECT word FROM known) GROUP BY 1 HAVING count(*) >= 3""")
def vocab_drift(spark, sf_dir):
    return cu.vocab_drift(feedback(spark, sf_dir), t.table(spark, sf_dir, "part"), "p_name")


@register(f"""{WITH}, {PER_SESSION}, v AS (SELECT session_id, sessions, CASE WHEN yes THEN approved ELSE sessions - approved END - 1 AS same
        FROM session_votes JOIN totals USING ({PAIR}) WHERE sessions > 1)
    SELECT session_id, count(*) AS pairs, sum(sessions - 1)::BIGINT AS compared, sum(same)::BIGINT AS agreed,
        round(sum(same)::DOUBLE / sum(sessions - 1), 6) AS agreement FROM v GROUP BY 1""")
def annotator_agreement(spark, sf_dir):
    return rounded(cu.annotator_agreement(feedback(spark, sf_dir)), "agreement")


@register(f"""{WITH}, {PER_SESSION}, v AS (SELECT a.session_id AS session_a, b.session_id AS session_b, count(*) AS shared,
        count(*) FILTER (a.yes = b.yes) AS agreed FROM session_votes a JOIN session_votes b USING ({PAIR}) WHERE a.session_id < b.session_id GROUP BY 1, 2)
    SELECT *, round(agreed::DOUBLE / shared, 6) AS agreement FROM v WHERE shared >= 3""")
def session_agreement(spark, sf_dir):
    return rounded(agreement.session_agreement(feedback(spark, sf_dir)), "agreement")


@register(f"""{WITH}, {PER_SESSION}, v AS (SELECT session_id, yes = (2 * approved > sessions) AS same
        FROM session_votes JOIN totals USING ({PAIR}) WHERE 2 * approved <> sessions)
    SELECT session_id, count(*) AS votes, round(avg(same::INT), 6) AS weight FROM v GROUP BY 1""")
def annotator_weights(spark, sf_dir):
    return rounded(cu.annotator_weights(feedback(spark, sf_dir)), "weight")
