"""Quality rules: fixed limits, then an isolation forest on the statistics the rules are made of.

Every text gives a few counts.  Fixed limits reject the plain cases.  For the rest, a forest of
random splits tells how easily a document is set apart from good ones: few splits mean an unusual
document.  The splits are drawn without a look at the rows; what a tree knows is how many of all good labelled
rows each of its nodes holds, and the threshold follows from the scores of all labelled rows.  Both are counts
of bounded size, taken in tasks; no more than ``LOCAL`` labelled rows are counted on the driver instead, with
the same result.  Verdicts cost one pass without shuffle; the forest is a few hundred KB.

Defined results: a null or empty text has no words and fails the limits; without labelled rows of
both qualities the limits alone decide; of several labels of one document the lowest counts; labels
without ``doc_id`` or quality are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm import words as w
from catalogmatch.llm.staging import stage
from catalogmatch.session import fits

LOCAL = 6000  # up to so many labelled rows are counted on the driver, all of them; more are counted in tasks
TREES = 100
TREE_ROWS = 256
DEPTH = 8
BINS = 1 << 16  # of scores, for the threshold
GOOD_KEPT = 0.998  # share of the good labelled rows that the threshold must keep
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")

# ---- fixed values: characters that count as symbols ----
SYMBOLS = b"#*$%&|<>"
# ---- end of fixed values ----


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER = _table(SYMBOLS), _table(bytes(range(65, 91)))
_CHAR = ~(w._SPACE | ((np.arange(256) & 0xC0) == 0x80))  # first bytes of the characters of words


def _repeated_words(x: w.Words) -> np.ndarray:
    """Per text the words in windows of three that the text has twice or more."""
    at = w.inside(x, 3)
    text = x.text_of()
    key = w.mix(w.windows(x.hash, 3)[at] ^ w.mix(text[at].astype(np.uint64)))
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[n[back] > 1]
    edge = np.zeros(len(x.hash) + 3, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 3, -1)
    covered = np.cumsum(edge)[:len(x.hash)] > 0
    return np.bincount(text[covered], minlength=len(x.counts))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``COUNTS`` for each text."""
    out = [np.zeros((0, len(COUNTS)), np.int64)]
    for low, high in w.slices(texts):
        x = w.split(texts.slice(low, high - low))

        def per_text(mask: np.ndarray, x=x) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[x.text_at[1:]] - total[x.text_at[:-1]]

        lines, again = [], []
        for a, b in zip(x.text_at[:-1], x.text_at[1:], strict=True):
            own = [line for line in x.data[a:b].tobytes().split(b"\n") if line.strip()]
            lines.append(len(own))
            again.append(len(own) - len(set(own)))
        d = x.data
        out.append(np.stack([x.counts, per_text(_CHAR[d]), per_text(_SYMBOL[d]), np.array(again), _repeated_words(x), np.array(lines),
                             per_text(_UPPER[d]), per_text(d == 33)], axis=1).astype(np.int64))
    return np.concatenate(out)


def features(counts: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 that the forest splits on; none grows with the length of a text.

    Symbols and exclamation marks per word level off, so that one in four words weighs half as much
    as many in each.
    """
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    n, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    symbols, shouts = c["n_symbols"] / n, c["n_shouts"] / n
    return np.stack([symbols / (symbols + 0.25), shouts / (shouts + 0.25), c["n_upper"] / chars, c["n_repeat_words"] / n,
                     c["n_dup_lines"] / lines], axis=1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    n = counts[:, 0]
    return (n < MIN_WORDS) | (100 * counts[:, COUNTS.index("n_repeat_words")] > MAX_REPEAT_PERCENT * n)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random binary tree of ``n`` rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), split value, first child, and path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    rows: int

    @classmethod
    def grow(cls, width: int, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
        """Random splits of the unit cube, each at a random place of its box, down to ``depth``; no row is looked at.

        Splitting the box and not only the rows in it tells apart what no row has.
        """
        rng = np.random.default_rng(seed)
        nodes, inner = 2 ** (depth + 1) - 1, 2 ** depth - 1
        feature, value = np.full((trees, nodes), -1), np.zeros((trees, nodes))
        feature[:, :inner] = rng.integers(width, size=(trees, inner))
        low, high, tree = np.zeros((trees, nodes, width)), np.ones((trees, nodes, width)), np.arange(trees)
        for node in range(inner):
            f = feature[:, node]
            value[:, node] = cut = rng.uniform(low[tree, node, f], high[tree, node, f])
            for k in (1, 2):
                low[:, 2 * node + k], high[:, 2 * node + k] = low[:, node], high[:, node]
            high[tree, 2 * node + 1, f] = low[tree, 2 * node + 2, f] = cut
        child = np.broadcast_to(2 * np.arange(nodes) + 1, (trees, nodes))
        return cls(feature, value, child, np.zeros((trees, nodes)), 0)

    def masses(self, data: np.ndarray) -> np.ndarray:
        """How many rows of ``data`` each node of each tree holds."""
        out = np.zeros(self.feature.shape, np.int64)
        for total, feature, value, child in zip(out, self.feature, self.value, self.child, strict=True):
            node, rows = np.zeros(len(data), np.int64), np.arange(len(data))
            while len(rows):
                total += np.bincount(node[rows], minlength=len(total))
                rows = rows[feature[node[rows]] >= 0]
                at = node[rows]
                node[rows] = child[at] + (data[rows, feature[at]] >= value[at])
        return out

    def settled(self, mass: np.ndarray, rows: int = TREE_ROWS) -> Forest:
        """The forest that knows its masses: a node is a leaf where less than two of ``rows`` rows would be left."""
        total = int(mass[0, 0])
        rows = min(rows, total)
        here = mass * (rows / total)
        above = np.floor(np.log2(np.arange(mass.shape[1]) + 1))
        return Forest(np.where(here < 2, -1, self.feature), self.value, self.child, above + _mean_path(here), rows)

    def score(self, data: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total, rows = np.zeros(len(data)), np.arange(len(data))
        for feature, value, child, path in zip(self.feature, self.value, self.child, self.path, strict=True):
            node = np.zeros(len(data), np.int64)
            live = rows
            while len(live):
                f = feature[node[live]]
                live, f = live[f >= 0], f[f >= 0]
                at = node[live]
                node[live] = child[at] + (data[live, f] >= value[at])
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(_mean_path(self.rows)), 1e-9))


@dataclass
class Model:
    forest: Forest | None
    threshold: float

    def anomalous(self, counts: np.ndarray) -> np.ndarray:
        if self.forest is None:
            return np.zeros(len(counts), bool)
        return self.forest.score(features(counts)) > self.threshold


def _bins(forest: Forest, data: np.ndarray) -> np.ndarray:
    return np.minimum(forest.score(data) * BINS, BINS - 1).astype(np.int64)


def cut(good: np.ndarray, bad: np.ndarray, good_kept: float = GOOD_KEPT) -> float:
    """The threshold that best parts good rows from bad, given how many of each have a score in each bin.

    It keeps at least ``good_kept`` of the good rows; of such thresholds it maximizes the share of
    bad rows caught less the share of good rows lost.
    """
    seen = np.flatnonzero(good + bad)
    kept = np.cumsum(good)[seen] / good.sum()
    caught = 1 - np.cumsum(bad)[seen] / bad.sum()
    allowed = kept >= good_kept
    best = np.flatnonzero(allowed)[np.argmax((kept + caught)[allowed])]
    above = seen[best + 1] if best + 1 < len(seen) else seen[best] + 1
    return float(np.nextafter((seen[best] + 1 + above) / 2 / BINS, 0))  # above all of its bin, below the next


def calibrate(counts: np.ndarray, good: np.ndarray, good_kept: float = GOOD_KEPT) -> Model:
    """Forest of the good rows that pass the limits, and the threshold that best parts them from the bad."""
    own = ~base_failed(counts)
    data, good = features(counts[own]), good[own]
    if not good.any() or good.all():
        return Model(None, 1.0)
    forest = Forest.grow(data.shape[1])
    forest = forest.settled(forest.masses(data[good]))
    bins = _bins(forest, data)
    return Model(forest, cut(np.bincount(bins[good], minlength=BINS), np.bincount(bins[~good], minlength=BINS), good_kept))


def _table_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1)


def _held(batches: Iterator[pa.RecordBatch], forest) -> Iterator[pa.RecordBatch]:
    """``place, n``: how many rows each node of the forest holds, the nodes numbered through all trees."""
    total = np.zeros(forest.value.feature.size, np.int64)
    for batch in batches:
        total += forest.value.masses(features(_table_of(batch))).ravel()
    yield pa.record_batch({"place": np.flatnonzero(total), "n": total[total > 0]})


def _scored(batches: Iterator[pa.RecordBatch], forest) -> Iterator[pa.RecordBatch]:
    """``place, n``: how many rows have a score in each bin, bad ones numbered after the good."""
    total = np.zeros(2 * BINS, np.int64)
    for batch in batches:
        bad = batch.column("quality").to_numpy() != 1
        total += np.bincount(_bins(forest.value, features(_table_of(batch))) + BINS * bad, minlength=len(total))
    yield pa.record_batch({"place": np.flatnonzero(total), "n": total[total > 0]})


def _summed(rows: DataFrame, function, forest: Forest, size: int) -> np.ndarray:
    """The counts of all tasks, added up; at most ``size`` rows reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    out = np.zeros(size, np.int64)
    for row in rows.mapInArrow(partial(function, forest=shared), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[row["place"]] = row["n"]
    return out


def calibrate_all(measured: DataFrame) -> Model:
    """The model of ``calibrate`` for a table ``quality`` and ``COUNTS`` of any size, counted in tasks."""
    own = measured.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")))
    kinds = {row["good"]: row["n"] for row in own.groupBy((F.col("quality") == 1).alias("good")).agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return Model(None, 1.0)
    forest = Forest.grow(features(np.zeros((1, len(COUNTS)), np.int64)).shape[1])
    mass = _summed(own.where("quality = 1"), _held, forest, forest.feature.size)
    forest = forest.settled(mass.reshape(forest.feature.shape))
    bins = _summed(own, _scored, forest, 2 * BINS)
    return Model(forest, cut(bins[:BINS], bins[BINS:]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = statistics(batch.column("text"))
        yield pa.record_batch({c: batch.column(c) for c in ("labelled", "row")} | {name: counts[:, i].copy() for i, name in enumerate(COUNTS)})


def fit(docs: DataFrame, labels: DataFrame, local: int = LOCAL) -> Model:
    """Fit on all labelled documents; up to ``local`` of them are counted on the driver.

    Of rows that share a labelled id the one whose text has the least hash is taken.  Texts stay where they are
    read: only counts are joined with the labels.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.min("quality").cast("long").alias("quality"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("labelled"), F.xxhash64("text").alias("row"), "text")
    counted = rows.mapInArrow(_counted, "labelled long, row long, " + ", ".join(f"{c} long" for c in COUNTS))
    one = counted.join(chosen, "labelled").groupBy("labelled").agg(F.min(F.struct("row", "quality", *COUNTS)).alias("one"))
    measured = stage(one.select("one.quality", *[f"one.{c}" for c in COUNTS]), "quality-labelled")
    if not fits(measured, local):
        return calibrate_all(measured)
    table = measured.toPandas().sort_values(["quality", *COUNTS])
    return calibrate(table[list(COUNTS)].to_numpy(np.int64), table["quality"].to_numpy() == 1)


def _judged(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = statistics(batch.column("text"))
        failed = base_failed(counts)
        out = {"doc_id": batch.column("doc_id")} | {name: counts[:, i].copy() for i, name in enumerate(COUNTS[:5])}
        kept = ~failed & ~model.value.anomalous(counts)
        yield pa.record_batch(out | {"base_failed": pa.array(failed), "kept": pa.array(kept)})


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    columns = ", ".join(f"{c} long" for c in COUNTS[:5])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(partial(_judged, model=shared), f"doc_id long, {columns}, base_failed boolean, kept boolean")


def _passed(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = statistics(batch.column("text"))
        yield batch.filter(pa.array(~base_failed(counts) & ~model.value.anomalous(counts)))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return docs.mapInArrow(partial(_passed, model=docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
