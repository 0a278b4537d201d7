"""Near duplicates among rows that share a doc_id or have none."""

import random
from collections import Counter

import corpus_pipeline


def test_each_row_goes_by_its_own_text(spark, tmp_path):
    rng = random.Random(5)
    base, lone, free, twice = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(3, base, "en"), (7, base + " end", "en"), (7, lone, "en"), (None, base + " more", "en"), (None, free, "en"), (None, free + " end", "en"),
            (9, twice, "de"), (9, twice, "en"), (10, "", "en"), (10, "", "en"), (None, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    kept = [k for k in found if k[0] is None and k[1] and k[1].startswith(free)]
    assert len(kept) == 1
    assert found - Counter(kept) == Counter([(3, base, "en"), (7, lone, "en"), (9, twice, "de"), (10, "", "en"), (10, "", "en"), (None, None, "en")])


def test_near_duplicates_with_columns_of_any_type_and_name(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, {"a": 2}, "x"), (1, base, {"a": 1}, "x"), (2, base + " end", {"b": 1}, "y"), (3, "other", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, key string")
    clashing = docs.withColumns({c: docs["key"] for c in ("__key", "__component", "component", "row", "n", "id", "kept", "all")})
    found = corpus_pipeline.near_duplicates(spark, clashing, str(tmp_path))
    assert found.columns == clashing.columns
    assert sorted((r.doc_id, str(r.m), r.key, r["__key"]) for r in found.collect()) == [(1, "{'a': 1}", "x", "x"), (3, "None", None, None)]
    assert corpus_pipeline.near_duplicates(spark, clashing.limit(0), str(tmp_path)).count() == 0
