"""Suffix dedup, ranked search and collocations on small tables, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogmatch.llm import bits, phrases, ranked, registered, suffixes

DOCS = "doc_id long, text string, lang string"
#: columns that the operators use inside
CLASH = ("key", "core", "known", "single", "value", "names", "number", "name", "windows", "left", "term", "ord", "item", "score", "rank",
         "h", "c", "n", "step", "shard", "phrase", "a", "l", "r")


def plain_removal(texts, window):
    """Kept bytes, removed bytes and spans of every text, from a table of all its windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                gone[i:i + window] = True
        edges = np.diff(np.append(0, gone.astype(int)))
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def repeating_texts(seed=3):
    """Copies, near copies, shared passages at any offset, periodic texts, several bytes a character, blanks."""
    rng = random.Random(seed)

    def prose(n, letters="abcdeé ñ日"):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, other = prose(300), prose(90)
    texts = []
    for _ in range(25):
        base = prose(rng.choice([20, 150, 400, 900]))
        texts.append(base)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(base))
            texts.append(base[:at] + prose(rng.randrange(4)) + base[at + rng.randrange(3):])
    texts += [prose(rng.randrange(70)) + passage + prose(rng.randrange(70)) for _ in range(12)]
    texts += [prose(rng.randrange(9)) + other + prose(rng.randrange(9)) + passage[rng.randrange(100):] for _ in range(12)]
    texts += [passage[:205], passage[7:], "ab" * 300, "x" * 150 + passage + "x" * 450, passage + passage, prose(500), texts[0], texts[0]]
    return [*texts, None, "", "é", prose(40_000), "=" * 199, "=" * 199]


@pytest.mark.parametrize("window", [32, 60, 200])
def test_suffix_dedup_agrees_with_a_table_of_all_windows(spark, window):
    texts = repeating_texts(window)
    rows = [(i, t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeated_bytes(docs, window).collect()}
    assert len(got) == len(rows)
    for (i, _, _), wanted in zip(rows, plain_removal(texts, window), strict=True):
        assert got[i] == wanted, i


def test_suffix_dedup_of_rows_alike_and_rows_without_id(spark):
    text, other = "".join(random.Random(1).choice("abcdef") for _ in range(400)), "z" * 10
    rows = [(1, text, "en"), (1, text, "en"), (None, "q" * 30 + text, None), (None, other, None), (1, other, "fr")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("taken") for c in CLASH})
    got = sorted(tuple(r) for r in suffixes.remove_repeated_bytes(docs, digest=True).select(
        F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("", other, "q" * 30)}
    assert got == sorted([(1, 400, 400, 1, sha[""]), (1, 400, 400, 1, sha[""]), (-1, 430, 400, 1, sha["q" * 30]),
                          (-1, 10, 0, 0, sha[other]), (1, 10, 0, 0, sha[other])])


def test_suffix_order_settles_most_windows_of_a_family(spark):
    """The order, not the comparison of single windows, finds what whole families share."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, f"{i:05d}" * 8 + base + f"{i:05d}" * 8, None) for i in range(60)]
    source = spark.createDataFrame(rows, DOCS).select(F.xxhash64("text").alias("key"), "text")
    lists, _ = suffixes.repeated(source)
    found = lists.select(F.size(F.coalesce("known", F.array().cast("array<long>"))).alias("known")).collect()
    assert len(found) == 60
    assert min(r.known for r in found) >= 60  # about a hundred anchors of 3,000 bytes


def test_suffix_dedup_on_empty_tables_and_short_windows(spark):
    assert suffixes.remove_repeated_bytes(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="fewer than 32"):
        suffixes.remove_repeated_bytes(spark.createDataFrame([], DOCS), window=20)


def test_suffix_query_on_documents(spark):
    """The registered query on the smallest tables."""
    import glob

    path = glob.glob("/root/testdata/sf0.001")
    if not path:
        pytest.skip("no driver tables")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registered.op11_suffix_dedup(spark, path[0]).collect()}
    rows = spark.read.parquet(f"{path[0]}/documents.parquet").select("doc_id", "text").collect()
    for r, wanted in zip(rows, plain_removal([r.text for r in rows], 200), strict=True):
        assert got[r.doc_id] == (*wanted[:3], hashlib.sha256(wanted[3]).hexdigest())


# ---- ranked search ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, length = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, t in terms:
            tf, m = Counter(t), 100 - 90 + (90 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in own if tf[w])
            if score > 0:
                scored.append((-score, 2**63 if i is None else i))
        out += [(item, rank, None if i == 2**63 else i, -score) for rank, (score, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def search_tables(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + [f"Rare{i}" for i in range(200)] + ["naïve", "Ñu", "a-b"]
    weights = [30] * 12 + [1] * 203
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, weights, k=rng.choice([1, 4, 20, 60])))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "..."), (403, docs[3][1]), (404, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (None, docs[5][1]), (405, "w1 " * 30_000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 8, 25])))) for i in range(40)]
    items += [(40, None), (41, "unknown words only"), (42, "w0 w0 W0"), (43, docs[3][1]), (7, "w3 rare9"), (None, "w2 rare1")]
    return docs, items


@pytest.mark.parametrize("k, stretch, block", [(10, 1_000_000, 200_000), (3, 40, 200_000), (10, 500, 60), (1000, 100, 200_000)])
def test_ranked_search_agrees_with_scoring_everything(spark, monkeypatch, k, stretch, block):
    monkeypatch.setattr(ranked, "STRETCH", stretch)  # tasks are forked from here or read their own: either way exact
    docs, items = search_tables()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit("taken") for c in CLASH})
    wanted = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in ranked.search(table, wanted, k, block_terms=block).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain_search(docs, items, k)


def test_a_stretch_stops_new_accumulators_and_stays_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        rows, terms, k = 80, 12, int(rng.integers(1, 6))
        dense = rng.integers(0, 9, (rows, terms)) * (rng.random((rows, terms)) < rng.random(terms)) * 10 ** rng.integers(0, 3, terms)
        doc, term = np.nonzero(dense)
        floors = np.array([0, int(dense.sum(1).max() // 2)])
        items = [rng.permutation(terms), rng.permutation(terms)[:5]]
        found = ranked.search_stretch(doc, term, dense[doc, term], rows, items, k, floors)
        for own, floor, (best, score) in zip(items, floors, found, strict=True):
            full = dense[:, own].sum(1)
            kth = max(np.sort(full)[-k], floor, 1)
            assert sorted(zip(best.tolist(), score.tolist())) == [(i, int(full[i])) for i in np.flatnonzero(full >= kth)]


def test_ranked_search_without_documents_or_items(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0


# ---- collocations ----

def plain_collocations(rows, least, share, top):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(own)
            for n in range(1, 5):
                counts[lang].update(tuple(own[i:i + n]) for i in range(len(own) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: c for p, c in f.items() if c >= least and len(p) > 1}
        ranking = []
        for p, a in often.items():
            if any(100 * c >= share * a for q, c in often.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranking.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranking)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def spoken(seed=6):
    rng = random.Random(seed)
    vocab = ["the", "of", "New", "york", "in", "ñu", "日本", "à"] + [f"w{i}" for i in range(60)]
    fixed = ["New York City hall", "once upon a time", "a a a a a", "in  the\tend", "as well as"]
    rows = []
    for i in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(vocab, k=rng.randrange(1, 9))) for _ in range(6)]
        rows.append((i, rng.choice([". ", " ", ", ", "\n", "\r\n", "\x0b"]).join(parts), rng.choice(["en", "en", "fr", None, "und"])))
    return [*rows, (300, None, "en"), (301, "", "xx"), (302, "...", None), rows[0], rows[0], (None, "once upon a time " * 40, "en"), (303, "z " * 20_000, "de")]


@pytest.mark.parametrize("least, top, shards", [(30, 2000, 2), (5, 40, 3), (8, 2000, 1), (12, 2000, 5)])
def test_collocations_agree_with_counting_everything(spark, monkeypatch, least, top, shards):
    monkeypatch.setattr(phrases, "SHARDS", shards)
    rows = spoken()
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("taken") for c in CLASH})
    found = phrases.collocations(docs, least=least, top=top)
    got = sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(rows, least, 80, top)


@pytest.mark.parametrize("shards, wanted", [(3, 6), (2, 5)])
def test_lengths_are_counted_in_interleaved_scans(spark, monkeypatch, shards, wanted):
    """Longer phrases start before shorter ones have ended, so few scans are needed.

    With three shards: words in the scans 0 to 2, pairs from 1, three words from 2, four in 3 to 5.
    """
    monkeypatch.setattr(phrases, "SHARDS", shards)
    docs = spark.createDataFrame([(i, "once upon a time there was", "en") for i in range(3000)], DOCS)
    counts, scans = phrases.frequent(docs)
    assert {r.c for r in counts.collect()} == {3000}
    assert counts.count() == 6 + 5 + 4 + 3
    assert scans == wanted


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_bitmaps_let_every_member_pass_and_few_others(spark):
    members = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    size = bits.size_for(20_000)
    found = bits.bitmap(members, "h", size)
    assert len(found) * 8 == size
    own = np.array([r.h for r in members.collect()], np.int64).view(np.uint64)
    assert bits.member(found, own).all()
    strangers = np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64)
    assert bits.member(found, strangers).mean() < 0.01


def test_translated_texts_keep_their_borders():
    from catalogmatch.llm.letters import table, translate

    texts = pa.array(["Ab-C", None, "", "É;x"])
    assert translate(texts.slice(0), table(b"-", b";")).to_pylist() == ["ab c", "", "", "É\nx"]
    assert translate(texts.slice(3), table(b"-", b";")).to_pylist() == ["É\nx"]


def test_a_stranger_of_the_cycle_before_is_counted_when_its_parts_are_frequent(monkeypatch):
    """The bitmap before lets ``a b c`` pass though ``a b`` was not met often enough: ``a b c d`` starts its cycle now."""
    text = pa.array(["a b c d"])
    of = phrases._Phrases(text, np.zeros(1, np.uint64)).of
    monkeypatch.setattr(phrases.bits, "member", lambda known, hashes: np.isin(hashes, known))
    now = np.concatenate([of[1], of[2], of[3]])
    before = np.concatenate([of[1], of[2][1:], of[3]])
    batch = pa.record_batch({"text": text, "lang": np.zeros(1, np.int64), "group": np.zeros(1, np.int32)})
    found = [h for b in phrases._count(iter([batch]), SimpleNamespace(value=now), SimpleNamespace(value=before), False) for h in b["h"].to_numpy().view(np.uint64)]
    assert sorted(found) == sorted([of[3][0], of[4][0]])
