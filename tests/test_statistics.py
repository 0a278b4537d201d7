"""Exact quantiles, agreement of sessions and rank distributions, against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from catalogmatch.operators import agreement, curation, quantiles

SHARES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "least": 0.0, "most": 1.0}


def plain_quantile(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
    return low + (high - low) * (at - np.floor(at))


@pytest.mark.parametrize("buckets", [2, 3, 1024])
def test_quantiles_are_exact_for_any_values(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = random.Random(buckets)
    groups = {
        "even": [rng.random() for _ in range(501)], "odd": [rng.gauss(0, 1e-9) + 1 for _ in range(200)],
        "ties": [rng.choice([0.1, 0.2, 0.3]) for _ in range(300)], "one": [7.5], "two": [-1.0, 2.0], "same": [0.25] * 40,
        "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 5e-324, 1e-323], "close": [0.1, np.nextafter(0.1, 1), 0.1, np.nextafter(0.1, 0)], None: [3.0, 1.0, 2.0]}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    rows += [("even", None), ("even", float("nan")), ("even", float("inf")), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.asDict() for r in quantiles.exact_quantiles(df, "g", "v", SHARES).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, share in SHARES.items():
            assert got[g][name] == plain_quantile(values, share), (g, name)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", SHARES).count() == 0


def feedback(spark, rows):
    return spark.createDataFrame(
        rows, "feedback_id string, timestamp_utc timestamp, session_id string, user_descricao string, user_marca string, user_medida string,"
              "match_cd_insumo bigint, score_sbert double, rank_posicao int, label int, variant string")


def vote(i, session, query, item, label, score=0.5, rank=1, variant="a"):
    import datetime

    return (str(i), datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=i), session, query, None, "", item, score, rank, label, variant)


def test_scores_are_not_rounded_before_their_quartiles(spark):
    scores = [0.12341, 0.12342, 0.12343, 0.12344, 0.9]
    rows = [vote(i, "s", "q", i, 1, s) for i, s in enumerate(scores)] + [vote(9, "s", "q", 9, None, 0.3), vote(10, "s", "q", 9, 0, None), vote(11, "s", "q", 9, 0, float("nan"))]
    got = {r.outcome: r for r in curation.score_by_label(feedback(spark, rows)).collect()}
    assert (got["approved"].q1, got["approved"].median, got["approved"].q3, got["approved"].votes) == (0.12342, 0.12343, 0.12344, 5)
    assert (got["rejected"].median, got["rejected"].votes, got["rejected"].deviation) == (0.3, 1, 0.0)


def test_ranks_of_approved_votes_by_variant(spark):
    rows = [vote(i, "s", "q", i, label, rank=rank, variant=v) for i, (v, rank, label) in enumerate(
        [("a", 1, 1), ("a", 1, 0), ("a", 2, 1), ("a", None, 1), ("b", 3, None), ("b", 3, 0)])]
    got = {(r.variant, r["rank"]): (r.votes, r.approved, r.approved_pct and round(r.approved_pct, 4)) for r in curation.ab_ranks(feedback(spark, rows), "variant").collect()}
    assert got == {("a", 1): (2, 1, 33.3333), ("a", 2): (1, 1, 33.3333), ("a", None): (1, 1, 33.3333), ("b", 3): (2, 0, None)}


def plain_agreement(rows, least):
    last = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[2] is not None:
            last[((r[3] or "").strip().upper(), r[6], r[2])] = r[9] == 1
    own = defaultdict(dict)
    for (query, item, session), yes in last.items():
        own[session][query, item] = yes
    out = {}
    for a, b in combinations(sorted(own), 2):
        shared = own[a].keys() & own[b].keys()
        if len(shared) >= least:
            agreed = sum(own[a][p] == own[b][p] for p in shared)
            out[a, b] = (len(shared), agreed, agreed / len(shared))
    return out


@pytest.mark.parametrize("least, hot", [(1, 63), (3, 63), (3, 2), (5, 0), (4, 63)])
def test_sessions_are_compared_where_they_share_enough(spark, monkeypatch, least, hot):
    monkeypatch.setattr(agreement, "HOT", hot)
    rng = random.Random(least)
    pairs = [("q%d" % (i % 40), i) for i in range(120)]
    rows = []
    for s in range(60):
        chosen = rng.sample(pairs[:15], rng.randrange(6)) + rng.sample(pairs, rng.randrange(9)) + ([pairs[0]] if rng.random() < 0.7 else [])
        rows += [vote(len(rows) + k, f"s{s}", q, i, rng.choice([0, 1, None])) for k, (q, i) in enumerate(chosen)]
    rows += [vote(len(rows) + k, "s1", "q0", 0, k % 2) for k in range(3)] + [vote(5000, None, "q0", 0, 1)]
    got = {(r.session_a, r.session_b): (r.shared, r.agreed, r.agreement) for r in agreement.session_agreement(feedback(spark, rows), least).collect()}
    wanted = plain_agreement(rows, least)
    assert got == wanted and (wanted or least == 5)


def test_a_pair_that_most_sessions_vote_on_brings_none_together(spark):
    """Half of all votes are on one pair; no two sessions share three, so none are compared."""
    rows = [vote(3 * s + k, f"s{s}", q, i, 1) for s in range(300) for k, (q, i) in enumerate([("hot", 1), (f"own{s}", 2), (f"own{s}", 3)])]
    assert agreement.session_agreement(feedback(spark, rows)).count() == 0
    assert Counter(r[3] for r in rows)["hot"] == 300


@pytest.mark.parametrize("meetings", [0, 10**9])
def test_sessions_compared_block_by_block_or_over_their_meetings(spark, monkeypatch, meetings):
    for name, value in {"MEETINGS": meetings, "BLOCK_VOTES": 60, "TILE": 4, "COLUMNS": 3, "BATCH_ROWS": 5}.items():
        monkeypatch.setattr(agreement, name, value)
    rng = random.Random(5)
    rows = []
    for s in range(40):
        name = ["s", "é", "\U0001f600", "～"][s % 4] + str(s)
        rows += [vote(len(rows) + k, name, f"q{i % 7}", i, rng.choice([0, 1, None])) for k, i in enumerate(rng.sample(range(30), rng.randrange(14)))]
    rows += [vote(len(rows) + k, "wide", f"q{i % 7}", i, 1) for k, i in enumerate(range(30))] + [vote(9000, None, "q0", 0, 1)]
    got = agreement.session_agreement(feedback(spark, rows)).collect()
    found = {frozenset((r.session_a, r.session_b)): (r.shared, r.agreed, r.agreement) for r in got}
    assert found == {frozenset(k): v for k, v in plain_agreement(rows, 3).items()} and len(got) == len(found) > 100
    assert all(r.session_a.encode() < r.session_b.encode() for r in got)


def test_no_list_of_sessions_that_meet_is_stored_where_most_of_them_do(spark, monkeypatch):
    stored = []
    store = agreement._stored
    monkeypatch.setattr(agreement, "_stored", lambda df, label: stored.append(store(df, label)) or stored[-1])
    rows = [vote(80 * s + i, f"s{s}", f"q{i}", i, (s + i) % 2) for s in range(100) for i in range(80)]
    assert agreement.session_agreement(feedback(spark, rows)).count() == 100 * 99 // 2
    assert max(df.count() for df in stored if "session_b" not in df.columns) == len(rows) and not any("session_b" in df.columns for df in stored)
