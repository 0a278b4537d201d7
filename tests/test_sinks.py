"""Sinks that survive a lost job, and counts kept by a stream."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from catalogmatch import schemas
from catalogmatch.session import shared_dir
from catalogmatch.sources import readers, versions, writers
from catalogmatch.streaming import feedback_stream

START = datetime.datetime(2025, 3, 1, 10)


def nested(spark, ids, minute=0, label=1):
    rows = [json.dumps({
        "feedback_id": i, "timestamp": (START + datetime.timedelta(minutes=minute)).isoformat() + "Z", "session_id": "s",
        "user_input": {"descricao": "tubo", "marca": None, "medida": "1 kg"}, "match": {"cd_insumo": 7, "status": "AT"},
        "scores": {"sbert": 0.5, "final": 61.5}, "rank": 1, "label": label, "app_version": "v", "knn_k": 30, "weights_snapshot": {"desc": 0.1}}) for i in ids]
    return spark.createDataFrame([(r,) for r in rows], "r string").select(F.from_json("r", schemas.FEEDBACK_NESTED).alias("v")).select("v.*")


def ids(df):
    return sorted(r.feedback_id or "" for r in df.select("feedback_id").collect())


def places(spark):
    return shared_dir(spark, "store"), shared_dir(spark, "lines")


def test_feedback_lost_between_its_two_places_ends_with_every_vote_once(spark, monkeypatch):
    store, lines = places(spark)
    writers.sink_feedback(nested(spark, ["a", "b"]), store, lines)
    votes = nested(spark, ["b", "c", "d"])
    from catalogmatch.sources import readers as used

    whole = used.flatten_feedback
    monkeypatch.setattr(used, "flatten_feedback", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        writers.sink_feedback(votes, store, lines)
    monkeypatch.setattr(used, "flatten_feedback", whole)
    assert ids(readers.scan_feedback_jsonl(spark, lines)) == ["a", "b", "c", "d"]
    assert ids(spark.read.parquet(store)) == ["a", "b"]
    assert writers.sink_feedback(votes, store, lines) is True
    assert writers.sink_feedback(votes, store, lines) is False  # marked: nothing is written
    for found in (readers.scan_feedback_jsonl(spark, lines), spark.read.parquet(store)):
        assert ids(found) == ["a", "b", "c", "d"]


def test_feedback_of_a_batch_lost_while_it_is_written(spark):
    store, lines = places(spark)
    writers.sink_feedback(nested(spark, ["a"]), store, lines)
    broken = nested(spark, ["b"]).withColumn("label", F.when(F.col("feedback_id") == "b", F.raise_error(F.lit("lost"))).cast("int"))
    with pytest.raises(Exception, match="lost"):
        writers.sink_feedback(broken, store, lines, batch="two")
    assert ids(spark.read.parquet(store)) == ["a"]
    writers.sink_feedback(nested(spark, ["b", "a", "c"]), store, lines, batch="two")
    assert ids(spark.read.parquet(store)) == ids(readers.scan_feedback_jsonl(spark, lines)) == ["a", "b", "c"]


def test_feedback_with_repeated_and_missing_ids(spark):
    store, lines = places(spark)
    votes = nested(spark, ["a", None, None]).unionByName(nested(spark, ["a"], minute=5, label=0)).unionByName(nested(spark, ["a"], minute=2))
    writers.sink_feedback(votes, store, lines)
    assert ids(spark.read.parquet(store)) == ["", "", "a"]
    assert spark.read.parquet(store).where("feedback_id = 'a'").first().label == 0  # the last vote counts
    writers.sink_feedback(nested(spark, []), store, lines)
    assert ids(readers.scan_feedback_jsonl(spark, lines)) == ["", "", "a"]


def test_feedback_tables_take_each_vote_once(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS sinks")
    try:
        name = "sinks.feedback_" + shared_dir(spark, "x").rsplit("-", 1)[1]
        for wanted in (["a", "b"], ["b", "c"], ["b", "c"]):
            writers.sink_feedback(nested(spark, wanted), name)
        assert ids(spark.table(name)) == ["a", "b", "c"]
    finally:
        spark.sql("DROP DATABASE sinks CASCADE")


# ---- the unit map ----

def units(spark, *pairs):
    return spark.createDataFrame(list(pairs), schemas.UNIT_MAP)


def content(df):
    return sorted((r.cd_medida, r.medida) for r in df.collect())


def broken(df):
    return df.withColumn("medida", F.when(F.col("cd_medida") == "L", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("medida")))


def test_a_unit_map_lost_while_it_is_written_leaves_the_old_one(spark):
    path = shared_dir(spark, "units")
    writers.sink_replace_small(units(spark, ("KG", "KILOGRAMA")), path)
    before = readers.read_small(spark, path)
    with pytest.raises(Exception, match="lost"):
        writers.sink_replace_small(broken(units(spark, ("G", "GRAMA"), ("L", "LITRO"))), path)
    assert content(readers.read_small(spark, path)) == [("KG", "KILOGRAMA")]
    os.makedirs(versions.folder(path.removeprefix("file:"), 7) + "/_temporary", exist_ok=True)  # a run that never ended
    assert content(readers.read_small(spark, path)) == [("KG", "KILOGRAMA")]
    writers.sink_replace_small(units(spark, ("G", "GRAMA")), path)
    assert content(readers.read_small(spark, path)) == [("G", "GRAMA")]
    assert content(before) == [("KG", "KILOGRAMA")]  # a reader under way keeps its files
    for n in range(3):
        writers.sink_replace_small(units(spark, ("N", str(n))), path)
    assert content(readers.read_small(spark, path)) == [("N", "2")]
    assert len(versions.complete(spark, path)) == 2


def test_a_unit_map_written_plainly_is_read_until_it_is_replaced(spark):
    path = shared_dir(spark, "units")
    units(spark, ("KG", "KILOGRAMA")).write.parquet(path)
    assert content(readers.read_small(spark, path)) == [("KG", "KILOGRAMA")]
    writers.sink_replace_small(readers.read_small(spark, path).unionByName(units(spark, ("G", "GRAMA"))), path)
    assert content(readers.read_small(spark, path)) == [("G", "GRAMA"), ("KG", "KILOGRAMA")]


def test_a_unit_table_is_switched_to_its_new_content(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS sinks")
    try:
        name = "sinks.units_" + shared_dir(spark, "x").rsplit("-", 1)[1]
        writers.sink_replace_small(units(spark, ("KG", "KILOGRAMA")), name)
        with pytest.raises(Exception, match="lost"):
            writers.sink_replace_small(broken(units(spark, ("L", "LITRO"))), name)
        assert content(spark.table(name)) == [("KG", "KILOGRAMA")]
        writers.sink_replace_small(units(spark, ("G", "GRAMA")), name)
        assert content(spark.table(name)) == [("G", "GRAMA")]
    finally:
        spark.sql("DROP DATABASE sinks CASCADE")


# ---- counts kept by a stream ----

def deliver(spark, folder, votes):
    rows = [(i, START + datetime.timedelta(minutes=m), label) for i, m, label in votes]
    spark.createDataFrame(rows, "feedback_id string, timestamp_utc timestamp, label int").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, state):
    stream = spark.readStream.schema("feedback_id string, timestamp_utc timestamp, label int").parquet(folder)
    feedback_stream.count_votes(stream, out, state).awaitTermination()
    return sorted((int((r.window_start - START).total_seconds() // 3600), r.total, r.approved, r.rejected) for r in feedback_stream.live_counts(spark, out).collect())


def test_live_counts_follow_new_votes_and_count_each_once(spark, monkeypatch):
    monkeypatch.setattr(feedback_stream, "COMPACT", 3)
    folder, out, state = (shared_dir(spark, x) for x in ("votes", "counts", "state"))
    assert feedback_stream.live_counts(spark, out).count() == 0
    deliver(spark, folder, [("a", 0, 1), ("b", 10, 0), ("c", 70, None), ("a", 0, 1)])
    assert run(spark, folder, out, state) == [(0, 2, 1, 1), (1, 1, 0, 1)]
    deliver(spark, folder, [("a", 0, 1), ("d", 200, 1)])  # delivered again, and a new one
    assert run(spark, folder, out, state) == [(0, 2, 1, 1), (1, 1, 0, 1), (3, 1, 1, 0)]
    changed = spark.read.parquet(out).where("batch = 1").count()
    assert changed <= 2  # not the window of c
    deliver(spark, folder, [("e", 65, 1)])  # late
    assert run(spark, folder, out, state) == [(0, 2, 1, 1), (1, 2, 1, 1), (3, 1, 1, 0)]
    for n in range(4):
        deliver(spark, folder, [(f"n{n}", 500 + n, 1), ("b", 10, 0)])
        found = run(spark, folder, out, state)
    assert found == [(0, 2, 1, 1), (1, 2, 1, 1), (3, 1, 1, 0), (8, 4, 4, 0)]
    assert spark.read.parquet(out).where("batch = 6").count() == 4  # every third batch holds all windows
