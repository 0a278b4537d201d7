"""The number of benchmark blocks changes no verdict."""

from collections import Counter

from catalogmatch.llm import decontaminate

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three four five six seven eight"), (2, "uno due tre quattro cinque"),
         (3, "uno due tre quattro cinque")]
LEAKS = [(6, "uno due tre quattro cinque"), (6, "clean"), (None, "alpha beta gamma delta epsilon zeta eta theta"), (None, "clean too"),
         (None, "one two three four five six seven x uno due tre quattro cinque"), (6, "clean"),
         (7, "uno due tre quattro cinque one two three four five six seven eight")]


def test_blocks_give_one_row_for_each_row(spark):
    docs = spark.createDataFrame(LEAKS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = Counter({(6, 2, 5, 5, True): 1, (6, None, 0, 0, False): 2, (None, 1, 8, 8, True): 1, (None, None, 0, 0, False): 1,
                    (None, 2, 5, 5, True): 1, (7, 2, 8, 8, True): 1})
    for block_words in (1000, 9, 1):
        assert Counter(tuple(r) for r in decontaminate.judge(docs, items, block_words=block_words).collect()) == want
