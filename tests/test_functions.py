import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from catalogmatch.functions import measures, numbers, scoring, text, tokens


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def expected_fold(value):
    plain = unicodedata.normalize("NFKD", value.lower()).encode("ascii", "ignore").decode()
    return " ".join("".join(c for c in plain if c.isalnum() or c.isspace()).split())


def test_fold_agrees_with_the_unicode_database_on_every_character(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    lines = ["a" + "-b".join(chars[i:i + 400]) + "c" for i in range(0, len(chars), 400)]
    # characters whose case mapping is newer than one of the two Unicode tables may differ
    got = column(spark, lines, text.fold)
    assert got == [expected_fold(line) for line in lines]


def test_fold_edges(spark):
    values = [None, "", "  Não  É AÇO ", "5º ½ ﬁ", "!!!", "2.5grama", "a\x1cb", "TUBO  PVC/75"]
    assert column(spark, values, text.fold) == [
        "", "", "nao e aco", "5o 12 fi", "", "25grama", "a b", "tubo pvc75"]


def test_stopwords_keep_com_and_sem(spark):
    stop = text.portuguese_stopwords()
    values = ["tubo de pvc com rosca", "sem marca", "nao ate so", "de a o", "gonna cannot wanna"]
    assert column(spark, values, lambda c: text.drop_stopwords(c, stop)) == [
        "tubo pvc com rosca", "sem marca", "nao ate so", "", "gon can not wan"]


def test_distinct_words_keep_order_and_case(spark):
    values = ["b a b A  a", "", " x x ", "(Caixa) caixa (Caixa)"]
    assert column(spark, values, text.distinct_words) == ["b a A", "", "x", "(Caixa) caixa"]


def test_dot_zero_goes_anywhere(spark):
    assert column(spark, ["500.0", "1.05", "12.0.0", None], text.without_dot_zero) == [
        "500", "15", "12", None]


def test_measure_conversion(spark):
    cases = {
        "1.000,5 GRAMA": "0.5GRAMA",
        "0,05 LITRO": "50.0MILILITRO",
        "10 TONELADA": "10000000.0GRAMA",
        "3 POLEGADA": "3 POLEGADA",
        "2 METRO CUBICO": "2000000.0MILILITRO",
        "PACOTE 12 GRAMAS X": "12.0GRAMA",
        "grama ": "GRAMA",
        "58.14MILIGRAMA": "0.058140000000000004GRAMA",
        "0.01MILIGRAMA": "1e-05GRAMA",
        "3 pés": "914.4000000000001MILIMETRO",
        "4. METRO": "4000.0MILIMETRO",
    }
    assert column(spark, list(cases), measures.convert_measure) == list(cases.values())
    assert column(spark, [None, ""], measures.convert_measure) == [None, ""]


def test_decimal_text_is_the_shortest_repr(spark):
    rng = random.Random(7)
    values = [0.0, 1.0, 0.001, 0.0001, 0.00012, 1e-5, 1e7, 12345678.0, 123456789.25, 1e15, 1e16, -2.5e9]
    values += [round(rng.uniform(0, 999), rng.randint(0, 3)) * f
               for f in (1000, 1, 0.001, 1e6, 10, 304.8, 914.4) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.out for r in df.select("i", measures.decimal_text(F.col("v")).alias("out")).orderBy("i").collect()]
    assert got == [repr(v) for v in values]


def test_parse_measures(spark):
    values = ["1000grama", "pacote", "", None, "2,5kg", " 75 MM ", "10mm x 20", "12"]
    got = column(spark, values, measures.parse_measure)
    assert [(r.value, r.unit) for r in got] == [
        (1000.0, "grama"), (None, "pacote"), (None, ""), (None, ""), (2.5, "kg"), (75.0, "mm"),
        (None, "10mm x 20"), (12.0, "")]


def pairs(spark, rows, expression):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    return [r.out for r in df.select("i", expression(F.col("a"), F.col("b")).alias("out")).orderBy("i").collect()]


def test_measure_similarity(spark):
    rows = [("85grama", "85grama"), ("1000grama", "1000mililitro"), ("85grama", "100grama"),
            ("", "1000grama"), ("1000grama", ""), ("", ""), ("10", "20mm"), ("0,5g", "0,1g"),
            ("pacote", "pacote"), ("10g", "pacote 10g")]
    got = pairs(spark, rows, scoring.measure_similarity)
    assert [round(v, 9) for v in got] == [1.0, 0.0, 0.85, 1.0, 0.0, 1.0, 0.5, 0.6, 1.0, 1.0]


def subsequence(a, b):
    row = [0] * (len(a) + 1)
    for c in b:
        new = [0]
        for i, d in enumerate(a):
            new.append(row[i] + 1 if c == d else max(new[-1], row[i + 1]))
        row = new
    return row[-1]


def set_ratio(a, b):
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 1.0
    gap = 1 if shared else 0
    la, lb = len(shared) + gap + len(left), len(shared) + gap + len(right)
    best = 100 - 100 * (len(left) + len(right) - 2 * subsequence(left, right)) / (la + lb)
    if shared:
        best = max(best, 100 - 100 * (1 + len(left)) / (len(shared) + la),
                   100 - 100 * (1 + len(right)) / (len(shared) + lb))
    return best / 100


def test_common_subsequence():
    rng = random.Random(3)
    rows = [("tigre", "brasil do tigre"), ("brand2", "brand17"), ("kitten", "sitting"), ("", "a"), ("", "")]
    for top in (5, 61, 62, 63, 124, 200):
        for _ in range(15):
            rows.append(tuple("".join(rng.choice("abcdé ") for _ in range(rng.randint(max(1, top - 5), top)))
                              for _ in range(2)))
    assert [tokens.common_subsequence(a, b) for a, b in rows] == [subsequence(a, b) for a, b in rows]


def test_common_subsequences_of_many_pairs():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé 中") for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 90]))) for _ in range(600)]
    a, b = texts[::2], texts[1::2]
    assert tokens.common_subsequences(a, b).tolist() == [tokens.common_subsequence(x, y) for x, y in zip(a, b)]


def test_token_set_ratio_against_values_worked_out_by_hand(spark):
    # remainders "ab" and "ac" share one letter: 1 - 2 / 4; behind a shared word "x": 1 - 2 / 8
    rows = [("ab", "ac", 0.5), ("x ab", "x ac", 0.75), ("x", "x y", 1.0), ("a", "b", 0.0), ("", "a", 0.0), (None, "a", 0.0)]
    got = pairs(spark, [(a, b) for a, b, _ in rows], tokens.token_set_ratio)
    assert got == pytest.approx([want for *_, want in rows])


def test_token_set_ratio(spark):
    rng = random.Random(5)
    vocabulary = ["tubo", "pvc", "tigre", "do", "brasil", "75", "100", "esgoto", "marca", "sem", "brand17",
                  "conexao", "galvanizado" * 8]
    rows = [("", ""), ("tubo", ""), ("", "tubo"), (None, "tubo"), ("tubo pvc", "pvc tubo"),
            ("tigre", "tigre do brasil"), ("brand2", "brand17"), ("tigre", "sem marca"),
            ("tubo pvc 75", "tubo pvc 100"), ("  ", "tubo")]
    rows += [tuple(" ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(2)) for _ in range(300)]
    got = pairs(spark, rows, tokens.token_set_ratio)
    assert [round(v, 9) for v in got] == [round(set_ratio(a, b), 9) for a, b in rows]
    assert got[5] > 0.7 and all(0 <= v <= 1 for v in got)
    mirrored = pairs(spark, [(b, a) for a, b in rows], tokens.token_set_ratio)
    assert [round(v, 9) for v in mirrored] == [round(v, 9) for v in got]


def test_round_one_decimal(spark):
    values = [100 * a / n for n in (8, 16, 40, 80, 400, 2000, 3000) for a in range(0, n + 1, max(1, n // 200))]
    values += [0.15, 0.25, 0.35, 12.25, 12.75, 2.675, 40.15]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r.out for r in df.select("i", numbers.round_one_decimal(F.col("v")).alias("out")).orderBy("i").collect()]
    assert got == [round(float(v), 1) for v in values]


def score_rows(spark, rows, weights=None):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, sbert double, desc double, marca double, medida double, qd string, qm string, qx string")
    w = scoring.effective_weights(scoring.weights_struct(weights), F.col("qd"), F.col("qm"), F.col("qx"))
    scored = df.withColumn("w", w)
    return scored.select(
        "i", "w", scoring.weighted_score(F.col("w"), F.col("sbert"), F.col("desc"), F.col("marca"), F.col("medida"))
        .alias("score")).orderBy("i").collect()


def test_scores_and_weights(spark):
    got = score_rows(spark, [
        (0.0, 0.0, 0.0, 0.0, "x", "y", "z"),
        (1.0, 1.0, 1.0, 1.0, "x", "y", "z"),
        (1.0, 1.0, 0.0, 1.0, "x", "SEM MARCA", "1g"),
        (0.5, 0.5, 0.0, 0.5, "x", "", "1g"),
        (0.5, 0.5, 0.0, 0.5, "x", "SEM MARCA", "1g"),
        (0.8, 0.0, 0.0, 0.0, "", "", ""),
        (0.8, 0.0, 0.0, 0.0, None, None, None),
    ])
    assert [round(r.score, 9) for r in got] == [0.0, 1.0, 1.0, 0.5, 0.5, 0.8, 0.8]
    assert got[2].w.marca == 0.0
    assert all(abs(sum(r.w) - 1) < 1e-9 for r in got)
    zero = score_rows(spark, [(0.9, 1.0, 1.0, 1.0, "x", "y", "z")],
                      {"sbert": 0.0, "desc": 0.0, "marca": 0.0, "medida": 0.0})
    assert zero[0].score == 0.0 and sum(zero[0].w) == 0.0


def test_normalized_weights(spark):
    one = spark.range(1)
    w = lambda **k: scoring.normalized_weights(scoring.weights_struct(k))
    row = one.select(w(sbert=2.0, desc=0.0, marca=1.0, medida=1.0).alias("a"),
                     w(sbert=0.0, desc=0.0, marca=0.0, medida=0.0).alias("b"),
                     scoring.normalized_weights(scoring.weights_struct({})).alias("c")).first()
    assert tuple(row.a) == (0.5, 0.0, 0.25, 0.25)
    assert tuple(row.b) == tuple(row.c) == (0.5, 0.0, 0.25, 0.25)


def test_attribute_similarities_of_the_known_pair(spark):
    row = spark.range(1).select(
        tokens.token_set_ratio(F.lit("tubo pvc"), F.lit("tubo pvc esgoto")).alias("desc"),
        scoring.brand_similarity(F.lit("tigre"), F.lit("tigre")).alias("marca"),
        scoring.brand_similarity(F.lit("SEM MARCA"), F.lit("sem marca")).alias("none"),
        scoring.measure_similarity(F.lit("75mm"), F.lit("75mm")).alias("medida")).first()
    assert (row.desc, row.marca, row.medida, row.none) == (1.0, 1.0, 1.0, 0.0)
