"""Tokens at which different sets meet stay apart."""

from catalogmatch.llm import jaccard


def test_tokens_of_different_sets_are_not_folded(spark):
    high = 5 << 32
    met = {1: (0, high + 1, 1 << 40), 2: (0, high + 2, 1 << 40), 3: (0, high + 1, 1 << 40), 4: (7,)}
    rows = spark.createDataFrame([(t, s) for t, signs in met.items() for s in signs], "token long, sign long")
    assert sorted(r.token for r in jaccard.meeting_points(rows).collect()) == [1, 2]
