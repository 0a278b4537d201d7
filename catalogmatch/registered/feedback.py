"""Registered queries: feedback sources, statistics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.operators import feedback as fb
from catalogmatch.registered import tables as t
from catalogmatch.registered.registry import register
from catalogmatch.session import shared_dir
from catalogmatch.sources import readers, writers
from catalogmatch.streaming.feedback_stream import count_votes, live_counts
from catalogmatch.streaming.feedback_stream import feedback_stream_stats as stream_stats

TIME = "%Y-%m-%d %H:%M:%S.%f"
FLAT = ", ".join(
    f"strftime({c}, '{TIME}') AS {c}" if c == "timestamp_utc" else
    f"round({c}, 6) AS {c}" if c.startswith("score_") else c
    for c in t.FEEDBACK_RULES)
WITH = f"WITH {t.FEEDBACK_SQL}"
KEYS = """SELECT upper(trim(coalesce(user_descricao, ''))) AS key_descricao, upper(trim(coalesce(user_marca, ''))) AS key_marca,
    upper(trim(coalesce(user_medida, ''))) AS key_medida, feedback_id, label FROM feedback"""
PER_QUERY = "SELECT key_descricao, key_marca, key_medida, count(*) AS validations FROM keys GROUP BY ALL"
COUNTS = "SELECT count(*) AS total, count(*) FILTER (label = 1) AS approved, count(*) - count(*) FILTER (label = 1) AS rejected FROM feedback"


def shown(flat: DataFrame) -> DataFrame:
    """Stored feedback with printable time, rounded scores and the snapshot as text."""
    out = flat.withColumn("timestamp_utc", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    scores = [c for c in flat.columns if c.startswith("score_")]
    out = out.withColumns({c: F.round(c, 6) for c in scores})
    if "weights_snapshot" in flat.columns:
        out = out.withColumn("weights_snapshot", F.to_json("weights_snapshot"))
    return out


SNAPSHOT = f"""SELECT {FLAT}, s.weights_snapshot FROM feedback
    JOIN (SELECT cast(event_id AS string) AS id, {t.SNAPSHOT_SQL} AS weights_snapshot FROM events) s ON s.id = feedback_id"""


@register(f"{WITH} {SNAPSHOT}".replace("0.0,", "0,"))
def flatten_feedback(spark, sf_dir):
    return shown(readers.flatten_feedback(t.feedback_nested(spark, sf_dir)))


@register(f"{WITH} {SNAPSHOT}".replace("0.0,", "0,"))
def scan_feedback_jsonl(spark, sf_dir):
    path = shared_dir(spark, "jsonl")
    writers.sink_feedback(t.feedback_nested(spark, sf_dir), shared_dir(spark, "feedback"), path)
    return shown(readers.scan_feedback_jsonl(spark, path))


@register(f"{WITH} {SNAPSHOT}".replace("0.0,", "0,"))
def sink_feedback(spark, sf_dir):
    path = shared_dir(spark, "feedback")
    votes = t.feedback_nested(spark, sf_dir)
    writers.sink_feedback(votes.where("match.cd_insumo % 3 < 2"), path)
    writers.sink_feedback(votes, path)  # the votes of the first batch are in already
    writers.sink_feedback(votes, path)
    return shown(spark.read.parquet(path).drop("batch"))


@register(f"""{WITH} SELECT feedback_id, strftime(timestamp_utc, '{TIME}') AS "timestamp", user_marca AS "user_input.marca",
    match_cd_insumo AS "match.cd_insumo", round(score_final, 6) AS "scores.final", rank_posicao AS rank, label
    FROM feedback ORDER BY timestamp_utc, feedback_id""")
def scan_feedback(spark, sf_dir):
    read = readers.scan_feedback(t.feedback(spark, sf_dir))
    return read.select(
        "feedback_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "`user_input.marca`", "`match.cd_insumo`", F.round("`scores.final`", 6).alias("scores.final"), "rank", "label")


@register(f"{WITH} SELECT feedback_id, key_descricao, key_marca, key_medida FROM ({KEYS})")
def query_key(spark, sf_dir):
    return fb.query_key(t.feedback(spark, sf_dir)).select("feedback_id", *fb.KEY)


@register(f"{WITH} {COUNTS}")
def feedback_counts(spark, sf_dir):
    return fb.feedback_counts(t.feedback(spark, sf_dir))


@register(f"{WITH}, keys AS ({KEYS}) {PER_QUERY}")
def feedback_query_counts(spark, sf_dir):
    return fb.feedback_query_counts(t.feedback(spark, sf_dir))


@register(f"""{WITH}, keys AS ({KEYS}), per AS ({PER_QUERY})
    SELECT count(*) AS unique_queries, count(*) FILTER (validations >= 3) AS queries_3plus FROM per""")
def feedback_queries_3plus(spark, sf_dir):
    return fb.feedback_queries_3plus(t.feedback(spark, sf_dir))


@register(f"""{WITH}, keys AS ({KEYS}), per AS ({PER_QUERY})
    SELECT CASE WHEN key_descricao = '' THEN '(sem descrição)' ELSE key_descricao END
        || CASE WHEN key_marca = '' THEN '' ELSE ' · marca=' || key_marca END
        || CASE WHEN key_medida = '' THEN '' ELSE ' · medida=' || key_medida END AS query, validations
    FROM per ORDER BY validations DESC, key_descricao, key_marca, key_medida LIMIT 10""")
def feedback_top_queries(spark, sf_dir):
    return fb.feedback_top_queries(t.feedback(spark, sf_dir))


@register(f"{WITH} SELECT rank_posicao AS rank, count(*) AS validations FROM feedback WHERE rank_posicao IS NOT NULL GROUP BY 1 ORDER BY 1")
def feedback_rank_dist(spark, sf_dir):
    return fb.feedback_rank_dist(t.feedback(spark, sf_dir))


SHARES = """SELECT *, round(100.0::DOUBLE * approved / total, 1) AS approved_pct,
    round(100 - round(100.0::DOUBLE * approved / total, 1), 1) AS rejected_pct,
    total >= 50 AND abs(round(100.0::DOUBLE * approved / total, 1) - 50) > 25 AS imbalanced FROM counts"""


@register(f"{WITH}, counts AS ({COUNTS}) {SHARES}")
def feedback_balance(spark, sf_dir):
    return fb.feedback_balance(t.feedback(spark, sf_dir))


@register(f"""{WITH}, keys AS ({KEYS}), per AS ({PER_QUERY}), counts AS ({COUNTS}), shares AS ({SHARES}),
    u AS (SELECT count(*) AS unique_queries, count(*) FILTER (validations >= 3) AS queries_3plus FROM per)
    SELECT shares.*, u.*, total >= 1000 AND unique_queries >= 300 AS ready,
        greatest(0, 1000 - total) AS missing_validations, greatest(0, 300 - unique_queries) AS missing_queries,
        CAST(least(100, floor(100 * total / 1000)) AS BIGINT) AS validations_progress,
        CAST(least(100, floor(100 * unique_queries / 300)) AS BIGINT) AS queries_progress FROM shares, u""")
def feedback_readiness(spark, sf_dir):
    return fb.feedback_readiness(t.feedback(spark, sf_dir))


HOURS = f"""{WITH}, hours AS (SELECT date_trunc('hour', timestamp_utc) AS h, count(*) AS total,
        count(*) FILTER (label = 1) AS approved FROM feedback GROUP BY 1)
    SELECT strftime(h, '{TIME}') AS window_start, total, approved, total - approved AS rejected FROM hours"""


def _shown_hours(counts: DataFrame) -> DataFrame:
    return counts.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "total", "approved", "rejected")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = t.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return t.feedback_from_events(events)


@register(f"{HOURS} WHERE h + INTERVAL 1 HOUR <= (SELECT max(timestamp_utc) - INTERVAL 1 HOUR FROM feedback)")
def feedback_stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    out = shared_dir(spark, "live")
    stream = stream_stats(_stream(spark, sf_dir)).writeStream.format("parquet").option(
        "checkpointLocation", shared_dir(spark, "live-state")).outputMode("append").trigger(availableNow=True).start(out)
    stream.awaitTermination()
    return _shown_hours(spark.read.parquet(out))


@register(HOURS)
def feedback_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, those still open included."""
    out = shared_dir(spark, "votes")
    count_votes(_stream(spark, sf_dir), out, shared_dir(spark, "votes-state")).awaitTermination()
    return _shown_hours(live_counts(spark, out))
