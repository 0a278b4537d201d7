"""Ranked lexical search, term at a time with limited accumulators.

Documents are searched where they are read.  A task gathers the postings of the query terms for a
stretch of documents, then takes each item's terms one after the other, rarest first.  While what the
remaining terms can still add reaches the k-th best partial score, a document met for the first time
gets an accumulator; after that no new ones are made, accumulators that can no longer reach that score
are given up, and the others go on to collect their exact scores.  Both the partial scores of the
stretch and the final ones of the stretches before count towards the k-th best.  Of every task k rows
for each item are shuffled.

Items come in blocks of ``BLOCK_TERMS`` terms, one pass over the documents each, so what is broadcast
has a fixed bound.  Statistics are sums over all documents.

Defined results: a null or empty text and one without terms is no document of the collection; an item
without terms has no rows; items that share an id are one item with the terms of all; repeated rows are
ranked each; a document without id ranks behind its equals; weights of zero score nothing; an empty
table gives no rows; columns other than ids and texts are ignored.  Working memory is a few hundred
bytes per word of the longest text, and per posting of a stretch of ``STRETCH`` postings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.llm import words as w
from catalogmatch.llm.letters import table, translate
from catalogmatch.llm.staging import LAST, stage

BLOCK_TERMS = 200_000
STRETCH = 1_000_000
_OTHER = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LETTERS = table(_OTHER)


def _terms(texts: pa.Array) -> w.Words:
    return w.split(translate(texts, _LETTERS))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("item_id")
        for low, high in w.slices(texts):
            x = _terms(texts.slice(low, high - low))
            yield pa.record_batch({"item_id": ids.slice(low, high - low).take(pa.array(x.text_of())), "term": x.hash.view(np.int64)})


def _found(x: w.Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term (place in the sorted ``vocabulary``) and count of every pair that occurs."""
    at = np.minimum(np.searchsorted(vocabulary, x.hash), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == x.hash)
    pair, tf = np.unique(x.text_of()[hit] * len(vocabulary) + at[hit], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), tf


def _statistics(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Sums of a task: documents of each term; at -1 all documents with a term, at -2 all terms."""
    known = vocabulary.value
    df, documents, length = np.zeros(len(known), np.int64), 0, 0
    for batch in batches:
        texts = batch.column("text")
        for low, high in w.slices(texts):
            x = _terms(texts.slice(low, high - low))
            documents += int((x.counts > 0).sum())
            length += len(x.hash)
            df += np.bincount(_found(x, known)[1], minlength=len(known))
    seen = np.flatnonzero(df)
    yield pa.record_batch({"term": np.append([-1, -2], seen).astype(np.int32), "n": np.append([documents, length], df[seen]).astype(np.int64)})


def search_stretch(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, items: list[np.ndarray], k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each item the rows (below ``rows``) that may be among the k best, with their exact scores.

    ``doc, term, impact`` are postings; ``items`` holds each item's terms rarest first; ``floors`` the
    scores that k rows elsewhere have already.  Rows that tie with the k-th best are all returned.
    """
    order = np.argsort(term, kind="stable")
    doc, term, impact = doc[order], term[order], impact[order]
    names, begin = np.unique(term, return_index=True)
    place = {int(t): i for i, t in enumerate(names)}
    end = np.append(begin[1:], len(term))
    most = np.maximum.reduceat(impact, begin) if len(begin) else np.zeros(0, np.int64)
    out = []
    for terms, floor in zip(items, floors, strict=True):
        own = [place[t] for t in terms.tolist() if t in place]
        left = np.append(np.cumsum(most[own][::-1])[::-1], 0) if own else np.zeros(1, np.int64)
        if left[0] < max(floor, 1):
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        score, alive, kth = np.zeros(rows, np.int64), None, max(int(floor), 1)
        for r, t in enumerate(own):
            d, c = doc[begin[t]:end[t]], impact[begin[t]:end[t]]
            if alive is None:
                score[d] += c
            else:
                kept = alive[d]
                score[d[kept]] += c[kept]
            if rows > k:
                kth = max(kth, int(np.partition(score, rows - k)[rows - k]))
            if alive is not None:
                alive &= score + left[r + 1] >= kth
            elif left[r + 1] < kth:
                alive = (score > 0) & (score + left[r + 1] >= kth)
        best = np.flatnonzero(score >= kth if alive is None else alive & (score >= kth))
        out.append((best, score[best]))
    return out


def _search(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of a task for each item, as ``item`` (place in the block), ``doc_id``, ``score``."""
    vocabulary, weight, items, documents, length = block.value
    best_id = [np.zeros(0, np.int64) for _ in items]
    best_score = [np.zeros(0, np.int64) for _ in items]
    floors = np.zeros(len(items), np.int64)
    held: list[tuple[np.ndarray, ...]] = []
    ids: list[np.ndarray] = []
    rows = size = 0

    def work() -> None:
        doc, term, impact = (np.concatenate([h[i] for h in held]) for i in range(3))
        own = np.concatenate(ids)
        for i, (found, score) in enumerate(search_stretch(doc, term, impact, rows, items, k, floors)):
            if len(found):
                all_id, all_score = np.append(best_id[i], own[found]), np.append(best_score[i], score)
                first = np.lexsort((all_id, -all_score))[:k]
                best_id[i], best_score[i] = all_id[first], all_score[first]
                floors[i] = best_score[i][-1] if len(first) == k else 0

    for batch in batches:
        texts = batch.column("text")
        doc_id = batch.column("ord").to_numpy(zero_copy_only=False)
        for low, high in w.slices(texts):
            x = _terms(texts.slice(low, high - low))
            m = 100 - 90 + (90 * x.counts * documents) // max(length, 1)
            text, term, tf = _found(x, vocabulary)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[text]))
            held.append((rows + text, term, impact))
            ids.append(doc_id[low:high])
            rows, size = rows + high - low, size + len(text)
            if size >= STRETCH:
                work()
                held, ids, rows, size = [], [], 0, 0
    if rows:
        work()
    for low in range(0, len(items), 1000):
        part = range(low, min(low + 1000, len(items)))
        yield pa.record_batch({
            "item": np.repeat(np.array(part, np.int32), [len(best_id[i]) for i in part]),
            "ord": np.concatenate([best_id[i] for i in part]), "score": np.concatenate([best_score[i] for i in part])})


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents with a score above 0 for each item."""
    spark = docs.sparkSession
    known = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(LAST)).alias("item_id"), "text")
    terms = stage(known.mapInArrow(_item_terms, "item_id long, term long").distinct(), "search-terms")
    blocks = -(-terms.count() // block_terms)
    texts = docs.select("text")
    found = None
    for b in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()
        if not len(part):
            continue
        own = part["term"].to_numpy().view(np.uint64)
        vocabulary = np.unique(own)
        shared = spark.sparkContext.broadcast(vocabulary)
        sums = texts.mapInArrow(partial(_statistics, vocabulary=shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(vocabulary) + 2, np.int64)  # the last two are the places -2 and -1
        counts[sums["term"].to_numpy()] = sums["n"].to_numpy()
        df, length, documents = counts[:-2], int(counts[-2]), int(counts[-1])
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        place = np.searchsorted(vocabulary, own)
        part["place"], part["df"] = place, df[place]
        groups = list(part[part["df"] > 0].sort_values(["df", "place"]).groupby("item_id", sort=True)["place"])
        names, lists = [None if name == LAST else int(name) for name, _ in groups], [places.to_numpy() for _, places in groups]
        block = spark.sparkContext.broadcast((vocabulary, weight, lists, documents, length))
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), "text").mapInArrow(
            partial(_search, block=block, k=k), "item int, ord long, score long")
        ids = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), "ord")
        top = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        top = top.join(F.broadcast(ids), "item").select(
            "item_id", "rank", F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), "score")
        top = stage(top, "search-block") if blocks > 1 else top
        if blocks > 1:
            block.unpersist()
            shared.unpersist()
        found = top if found is None else found.unionByName(top)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found


def twin(k: int = 10) -> str:
    """The rows of ``search`` in DuckDB SQL, every document scored for every item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH q AS (SELECT DISTINCT item_id, unnest({split}) AS term FROM benchmark),
        d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS t FROM documents),
        c AS (SELECT r, doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
        s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM c),
        p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM c) SEMI JOIN q USING (term) GROUP BY r, term),
        f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
        wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, s),
        m AS (SELECT r, doc_id, 100 - 90 + (90 * n * docs) // total AS m FROM c, s),
        i AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS impact FROM p JOIN wt USING (term) JOIN m USING (r)),
        t AS (SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, r, doc_id),
        o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM t WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""
