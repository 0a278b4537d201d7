"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case, so another case or punctuation hides nothing.
Benchmark items and documents meet at shared seeds of ``MATCH`` words.  For a document and an item
that share enough of them, tiles are laid: the longest run of words that both have and no tile
covers yet is marked, again and again, down to runs of ``MATCH`` words.  Runs are found by running
Karp-Rabin hashes, first of long windows, then of shorter ones.  Tiles may lie in any order, so
reordered passages count as well.  A document is contaminated when its tiles cover ``COVERAGE`` of an
item's words.

The benchmark is the query set: it is cut into blocks of ``BLOCK_WORDS`` words, each broadcast, and
every block meets all documents where these are scanned; each row carries its best item from block to
block, so the number of blocks changes no result.  Between blocks the rows are written down and the block is
let go.  No shuffle of documents, whatever passage many of them share.

Defined results: a null or empty text has no tiles (item null, coverage 0); of items covered alike
the smallest id is named, and of its texts covered alike the longest; items without text, or with fewer words than a match, cannot be found;
items without id are left out; repeated rows give repeated results; other columns are left alone and may
have any name.  Whole texts are searched; a long text of few different words costs the product of the places
that it and an item have for a seed, and an item is short.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm import words as w
from catalogmatch.llm.staging import stage

MATCH = 4
COVERAGE = 0.6
BLOCK_WORDS = 2_000_000
_BITS = 22


def _plain_words(texts: pa.Array) -> w.Words:
    return w.split(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "))


def _free_windows(values: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``size`` that hold no marked word."""
    hashes = w.windows(values, size)
    taken = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, hashes[at]


def _matches(a, b, used_a, used_b, size: int) -> list[tuple[int, int, int]]:
    """Unmarked runs of at least ``size`` words that both have: length, place in ``a``, place in ``b``."""
    if len(a) < size or len(b) < size:
        return []
    at_a, hash_a = _free_windows(a, used_a, size)
    at_b, hash_b = _free_windows(b, used_b, size)
    hit = np.isin(hash_b, hash_a)
    places = defaultdict(list)
    for p, h in zip(at_a.tolist(), hash_a.tolist(), strict=True):
        places[h].append(p)
    out = []
    for q, h in zip(at_b[hit].tolist(), hash_b[hit].tolist(), strict=True):
        for p in places[h]:
            if p and q and a[p - 1] == b[q - 1] and not used_a[p - 1] and not used_b[q - 1]:
                continue  # lies inside a longer one
            room = min(len(a) - p, len(b) - q)
            stop = np.flatnonzero((a[p:p + room] != b[q:q + room]) | used_a[p:p + room] | used_b[q:q + room])
            length = int(stop[0]) if len(stop) else room
            if length >= size:
                out.append((length, p, q))
    return out


def _free_runs(busy: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Start and length of the runs of at least ``least`` words that are not busy."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], busy, [True]]).astype(np.int8)))
    for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if stop - start >= least:
            yield start, stop - start


def tile(a: np.ndarray, b: np.ndarray, least: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of two arrays of word hashes: ``(length, place in a, place in b)`` of each tile.

    The longest match goes first, the one with the least places among equals.  What a tile leaves of a match
    goes back into the queue by its own length, before shorter matches are taken.
    """
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles, size = [], max(least, min(len(a), len(b)))
    while True:
        queue = [(-length, p, q) for length, p, q in _matches(a, b, used_a, used_b, size)]
        heapq.heapify(queue)
        while queue:
            length, p, q = heapq.heappop(queue)
            length = -length
            busy = used_a[p:p + length] | used_b[q:q + length]
            if not busy.any():
                used_a[p:p + length] = used_b[q:q + length] = True
                tiles.append((length, p, q))
                continue
            for start, rest in _free_runs(busy, size):
                heapq.heappush(queue, (-rest, p + start, q + start))
        if size == least:
            return tiles
        size = max(least, size // 2)


class Items:
    """Words of a block of benchmark items, and which items have which seeds."""

    def __init__(self, ids: list[int], texts: list[str], match: int):
        x = _plain_words(pa.array(texts, pa.string()))
        self.ids, self.match = ids, match
        self.words = [x.hash[a:b] for a, b in zip(x.first[:-1], x.first[1:], strict=True)]
        at = w.inside(x, match)
        seed, item, place = w.windows(x.hash, match)[at], x.text_of()[at], at - x.first[x.text_of()[at]]
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[self.seed >> np.uint64(64 - _BITS)] = True

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Which of the window hashes are seeds."""
        out = self.filter[values >> np.uint64(64 - _BITS)]
        at = np.flatnonzero(out)
        out[at] = np.isin(values[at], self.seed)
        return out

    def best(self, words: np.ndarray, seeds: np.ndarray, coverage: float) -> tuple[int | None, int, int]:
        """Item with the largest share of covered words: id, covered words, its words."""
        values = np.unique(seeds)
        low, high = np.searchsorted(self.seed, values), np.searchsorted(self.seed, values, side="right")
        rows = np.concatenate([np.arange(i, j) for i, j in zip(low, high, strict=True)])
        best = None
        for item in np.unique(self.item[rows]).tolist():
            own = self.words[item]
            reach = np.zeros(len(own) + 1, np.int64)
            start = self.place[rows[self.item[rows] == item]]
            np.add.at(reach, start, 1)
            np.add.at(reach, start + self.match, -1)
            possible = int((np.cumsum(reach[:-1]) > 0).sum())
            if possible < coverage * len(own) or best and possible / len(own) < best[1] / best[2]:
                continue
            found = (self.ids[item], sum(t[0] for t in tile(own, words, self.match)), len(own))
            if best is None or _rank(*found) > _rank(*best):
                best = found
        return best or (None, 0, 0)


def _rank(item: int, covered: int, size: int) -> tuple[float, int, int]:
    """The larger, the better the item: share covered, then the smaller id, then the longer text."""
    return covered / size, -item, size


def _near_seeds(values: np.ndarray, hit: np.ndarray, match: int) -> np.ndarray:
    """The words of the windows that are seeds, with a stranger between runs of them."""
    edge = np.zeros(len(values) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + match, -1)
    keep = np.cumsum(edge[:-1]) > 0
    gap = keep[:-1] & ~keep[1:]
    out = np.where(keep, values, np.uint64(0))
    return out[keep | np.concatenate([[False], gap])]


def _tiled(texts: pa.Array, items: Items, coverage: float) -> list[tuple[int | None, int, int]]:
    out = []
    for low, high in w.slices(texts):
        x = _plain_words(texts.slice(low, high - low))
        values = w.windows(x.hash, items.match)
        hit = np.zeros(len(x.hash), bool)
        at = w.inside(x, items.match)
        hit[at] = items.hits(values[at])
        total = np.concatenate([[0], np.cumsum(hit)])
        for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True):
            if total[b] == total[a]:
                out.append((None, 0, 0))
            else:
                own = hit[a:b]
                out.append(items.best(_near_seeds(x.hash[a:b], own, items.match), values[a:b][own[:len(values[a:b])]], coverage))
    return out


def _judged(batches: Iterator[pa.RecordBatch], items, coverage: float) -> Iterator[pa.RecordBatch]:
    """The rows with the best item of this block and those before it."""
    for batch in batches:
        best = list(zip(*[batch.column(c).to_pylist() for c in ("item_id", "n_covered", "n_item_words")], strict=True))
        for i, (item, covered, size) in enumerate(_tiled(batch.column("text"), items.value, coverage)):
            if item is not None and covered >= coverage * size and (best[i][0] is None or _rank(item, covered, size) > _rank(*best[i])):
                best[i] = (item, covered, size)
        item, covered, size = zip(*best, strict=True) if best else ((), (), ())
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": batch.column("text"), "item_id": pa.array(item, pa.int64()),
                               "n_covered": pa.array(covered, pa.int64()), "n_item_words": pa.array(size, pa.int64())})


def _clean(batches: Iterator[pa.RecordBatch], items, coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _tiled(batch.column("text"), items.value, coverage)
        yield batch.filter(pa.array([item is None or covered < coverage * size for item, covered, size in found], pa.bool_()))


def _blocks(benchmark: DataFrame, match: int, block_words: int):
    """The benchmark in broadcast blocks of bounded size; one item at least in each."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    sized = rows.select("*", F.size(F.split("text", r"[\x20\x09-\x0D]+")).cast("long").alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = -(-total // block_words)
    for part in range(parts):
        own = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect() if parts > 1 else (
            sized.orderBy("item_id", "text").collect())
        if own:
            yield benchmark.sparkSession.sparkContext.broadcast(Items([r.item_id for r in own], [r.text for r in own], match))


def _next(rows: DataFrame, before) -> DataFrame:
    """Write the rows down when a block before this one is done with, so no two blocks are held at once."""
    if before is None:
        return rows
    written = stage(rows, "tiles")
    before.unpersist()
    return written


def judge(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, match: int = MATCH,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, n_covered, n_item_words, contaminated``, one row for each row of ``docs``.

    The item is the one whose words are covered best, of those that reach ``coverage``; else null.
    """
    zero = F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("item_id"),
                       zero.alias("n_covered"), zero.alias("n_item_words"))
    before = None
    for block in _blocks(benchmark, match, block_words):
        rows = _next(rows, before)
        rows = rows.mapInArrow(partial(_judged, items=block, coverage=coverage),
                               "doc_id long, text string, item_id long, n_covered long, n_item_words long")
        before = block
    return rows.select("doc_id", "item_id", "n_covered", "n_item_words", F.col("item_id").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, match: int = MATCH,
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no benchmark item covers, with all their columns."""
    before = None
    for block in _blocks(benchmark, match, block_words):
        docs = _next(docs, before)
        docs = docs.mapInArrow(partial(_clean, items=block, coverage=coverage), docs.schema)
        before = block
    return docs
