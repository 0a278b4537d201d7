"""Rows that share a doc_id, or have none: no list of one key outgrows one text."""

import random

from pyspark.sql import functions as F

from catalogmatch.llm import private, quality, repeats


def test_lists_of_repeats_are_no_longer_than_a_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FEW", 2, raising=False)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts] + [(99, t) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = repeats.repeated_windows(repeats.ordered(docs))
    assert known.agg(F.max(F.size("known"))).first()[0] <= 28
    gone = {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    assert gone == {*((i, 0) for i in range(30)), (None, 40), (99, 40)}


def test_entities_are_gathered_by_text(spark):
    rows = [(None, f"mail a{i}@b.org") for i in range(50)] + [(7, f"mail c{i}@b.org") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert private._found(docs).groupBy("row").count().agg(F.max("count")).first()[0] == 1
    assert not {r.text for r in private.replace_private(docs).collect()} & {t for _, t in rows}


def test_one_row_for_each_label_reaches_the_driver(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "calibrate", lambda counts, good: seen.append((len(counts), sorted(good.tolist()))))
    docs = spark.createDataFrame([(1, f"text {i} " * i) for i in range(200)] + [(2, "other text")], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert seen == [(2, [False, True])]
