"""Texts of queries and items taken apart once, not for each pair."""

import itertools

from pyspark.sql import functions as F

from catalogmatch.operators import ranking
from catalogmatch.plans.search import score_candidates

TEXTS = [None, "", "  ", "tubo pvc", "pvc tubo tubo esgoto", "sem marca", "SEM MARCA", "10grama", "10 grama", "10,5kg", "12grama", "7", "pacote azul", " x "]


def pairs(spark):
    rows = [(i, *t) for i, t in enumerate(itertools.product(TEXTS, TEXTS))]
    both = spark.createDataFrame(rows, "id long, a string, b string")
    for side, text in (("q", "a"), ("d", "b")):
        both = both.withColumns({f"{side}_{name}": F.col(text) for name in ("descricao", "marca", "medida")})
    return both


def test_parts_give_what_the_texts_give(spark):
    def rows(df):
        scored = ranking.effective_weights(ranking.attribute_sims(df), {"sbert": 0.0, "desc": 0.5, "marca": 0.3, "medida": 0.2})
        return sorted(tuple(r) for r in scored.select("id", "sim_desc", "sim_marca", "sim_medida", F.to_json("weights")).collect())

    plain = pairs(spark)
    assert rows(ranking.with_parts(ranking.with_parts(plain, "q"), "d")) == rows(plain)


def test_no_text_is_taken_apart_above_the_join_of_many_candidates(spark):
    queries = spark.createDataFrame([(1, "tubo pvc", "x", "10grama")], "query_id long, descricao string, marca string, medida string")
    items = queries.selectExpr("query_id + 1 as cd_insumo", "descricao as insumo_descricao", "marca", "medida")
    found = spark.createDataFrame([(1, 2, 0.5)], "query_id long, cd_insumo long, score_sbert double")
    for rows in (None, 30):
        scored = score_candidates(found, queries, items, rows=rows)
        plan = scored.select("query_id", "cd_insumo", "score")._jdf.queryExecution().optimizedPlan().toString()
        head = plan[:plan.index("Join")]
        assert "split(" not in head and "regexp" not in head and "split(" in plan
        assert [(r.query_id, r.cd_insumo, r.score) for r in scored.collect()] == [(1, 2, scored.first().score)]
