"""Large families and common passages in the Jaccard join: few pairs are listed, no link is lost."""

import random

import numpy as np
import pyarrow as pa
from test_llm_ops import brute_components, counted

from catalogmatch.llm import jaccard


def test_few_sets_give_pairs_and_many_give_rows():
    rng = random.Random(5)
    held = {t: sorted(rng.sample(range(-30, 60), rng.choice([1, 1, 2, 3, 4, 5, 40]))) for t in range(-60, 60)}
    n = {s: rng.choice([90, 100, 200]) for s in range(-30, 60)}
    rows = [(t, s, n[s]) for t in sorted(held) for s in held[t] for _ in range(rng.choice([1, 1, 3]))]
    want = {(a, b) for some in held.values() if len(some) <= 4 for a in some for b in some if a < b and 75 * max(n[a], n[b]) <= 100 * min(n[a], n[b])}
    many = sorted((s, t) for t, some in held.items() if len(some) > 4 for s in some)
    for step in (1, 3, 7, 50, 10_000):
        batches = [pa.record_batch({"token": pa.array([r[0] for r in part], pa.int64()), "sign": pa.array([r[1] for r in part], pa.int64()),
                                    "n": pa.array([r[2] for r in part], pa.int32())}) for part in (rows[i:i + step] for i in range(0, len(rows), step))]
        found = [tuple(r.values()) for b in jaccard._shared(iter(batches), 4, 75) for r in b.to_pylist()]
        assert {(a, b) for a, b, m in found if not m} == want
        assert sorted((a, b) for a, b, m in found if m) == many


def test_a_pair_that_meets_often_is_listed_once():
    base = np.sort(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64))
    point, near = jaccard.count_vector(base, 6), (base >> np.uint64(48)).astype("<u2").tobytes()
    tokens, nodes = list(range(20)), list(range(30))
    rows = [(t, s) for t in tokens for s in nodes]
    same = {"cell": 0, "level": 6, "n": 100, "band": 6, "side": 2}
    batch = pa.record_batch({"token": [r[0] for r in rows], "node": [r[1] for r in rows], "component": [r[1] for r in rows],
                             "point": [point] * len(rows), "near": [near] * len(rows), "firsts": [tokens] * len(rows)}
                            | {k: [v] * len(rows) for k, v in same.items()})
    found = [(r["a"], r["b"]) for b in jaccard._candidates(iter([batch]), 75, True) for r in b.to_pylist()]
    assert len(found) == 30 * 29 // 2 == len({frozenset(p) for p in found})


def test_families_and_passages_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    template, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(120):
        words = [word() if rng.random() < rng.choice([0.0, 0.02, 0.05]) else x for x in template]
        rows.append((i, " ".join(words)))
    for i in range(60):
        rows.append((200 + i, " ".join(passage + [word() for _ in range(rng.choice([4, 12, 60, 300]))])))
    rows += [(300 + i, " ".join(passage[:5 + i % 2])) for i in range(30)] + [(400, None), (401, ""), (None, " ".join(template))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(jaccard.jaccard_components(docs)) == brute_components(rows)
