"""N-gram Jaccard join with a count-vector R-tree.

Every text becomes the set of its shingles of five words.  Texts of one set form a class and are
compared once.  Two sets that reach the similarity share one of the first quarter of their shingles
in any common order, so sets meet by these shingles only.  The order: shingles whose hash is below a
border and that at most ``LEAF`` sets have, then those above the border, each by hash, and last
those below it that more sets have.  Every set lists all it has below the border, so one count over
these lists tells how many sets have a shingle, and the few sets whose quarter is not full by then
list what is missing from above the border (``_later``).  A license line or a common passage brings
nobody together, and the pairs at a shingle of the first kind are at most ``LEAF`` for each set.

Sets are compared as points: shingles are hashed into groups, and the counts per group are the
coordinates; the sum of the smaller coordinates bounds the overlap.  A meeting of at most ``LEAF``
sets is one leaf, its pairs go to the bound with one group for four shingles at once.  Where more
meet, which is so for later shingles only, an R-tree bounds the overlap of a set with a whole box, and
what it cannot exclude meets the bound with 65,536 groups.  What is left is verified on the texts.

Large families of near copies are not spelled out pair by pair: where they meet at later shingles,
the first round tries one other set for each, the second looks only for pairs between what is not yet
connected.

Defined results: a null or empty text has an empty set and links with nothing; a row without
``doc_id`` is in no component (null); rows that share a ``doc_id`` are judged each by its own text;
other columns are ignored.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm import words as w
from catalogmatch.llm.components import components
from catalogmatch.llm.staging import stage

SHINGLE = 5
PERCENT = 75
LEAST_BAND, TREE_BAND = 6, 8  # at meeting points a set has 64 to 256 groups, afterwards as many as its size asks for
CELL = 2048
LEAF = 16
DIRECT = 64  # in cells of so many sets a tree costs more than all pairs of like size
NEAR = 512  # sets up to this size carry a count vector of 65,536 groups where they meet
FIRSTS = 24  # meetings that a set remembers, so that a pair is listed once for all of them
SPARE = 1.25  # shingles below the border, as a multiple of those by which sets meet


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, in ascending order of their hashes."""
    for low, high in w.slices(texts):
        x = w.split(texts.slice(low, high - low), fold=True)
        full = w.windows(x.hash, SHINGLE)
        for a, b in zip(x.first[:-1], x.first[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(full[a:b - SHINGLE + 1])
            else:
                yield w.windows(x.hash[a:b], int(b - a)) if b > a else full[:0]


def set_sign(shingles: np.ndarray) -> int:
    """64-bit hash of a set."""
    total = w.mix(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64)
    return int(w.mix(np.array([total]))[0].astype(np.int64))


def border(percent: int, share: float | None = None) -> np.uint64:
    """Hash that ``share`` of all shingles are below, by default somewhat more than sets meet by."""
    share = SPARE * (100 - percent) / 100 if share is None else share
    return np.uint64(min(int(share * 2.0 ** 32), 2**32 - 1) << 32)


def _prefix_size(n, percent: int):
    """Number of shingles one of which any set similar enough must share: all but the overlap it needs, and one."""
    return n - F.ceil(F.lit(percent) * n / 100) + 1


def band(n: int) -> int:
    """Sets of ``n`` shingles have ``2 ** band`` groups, so a group holds four at most on average."""
    return max(LEAST_BAND, (max(n, 1) - 1).bit_length() - 2)


def count_vector(shingles: np.ndarray, k: int) -> bytes:
    """Counts in ``2 ** k`` groups, behind the width of a count in bytes: one for all but very uneven sets."""
    counts = np.bincount((shingles >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    width = next(size for size in (1, 2, 4) if counts.max() < 1 << 8 * size)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def folded(vector: bytes, groups: int) -> np.ndarray:
    """The counts in that many groups, or in all if there are fewer: each is a sum of neighbours."""
    counts = np.frombuffer(vector, f"<u{vector[0]}", offset=1)
    return counts.reshape(min(groups, len(counts)), -1).sum(1, dtype=np.int64)


def _profiles(batches: Iterator[pa.RecordBatch], edge: np.uint64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in w.slices(batch.column("text")):
            n, below, sign, bands, points, fine = [], [], [], [], [], []
            for shingles in shingle_sets(batch.column("text").slice(low, high - low)):
                k = band(len(shingles))
                n.append(len(shingles))
                below.append(int(np.searchsorted(shingles, edge)))
                sign.append(set_sign(shingles))
                bands.append(min(k, TREE_BAND))
                points.append(count_vector(shingles, bands[-1]))
                fine.append(count_vector(shingles, k))
            yield pa.record_batch({"node": batch.column("node").slice(low, high - low), "n": pa.array(n, pa.int64()),
                                   "below": pa.array(below, pa.int64()), "sign": pa.array(sign, pa.int64()), "band": pa.array(bands, pa.int64()),
                                   "point": pa.array(points, pa.binary()), "fine": pa.array(fine, pa.binary())})


def _finer(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that the bound keeps with all groups of the smaller of two bands."""
    for batch in batches:
        keep = []
        for one, two in zip(batch.column("fine_a").to_pylist(), batch.column("fine_b").to_pylist(), strict=True):
            x, y = folded(one, 1 << 32), folded(two, 1 << 32)
            size = min(len(x), len(y))
            bound = int(np.minimum(x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)).sum())
            keep.append((100 + percent) * bound >= percent * int(x.sum() + y.sum()))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _listed(batches: Iterator[pa.RecordBatch], edge: np.uint64) -> Iterator[pa.RecordBatch]:
    """The shingles of each set below the border."""
    for batch in batches:
        for low, high in w.slices(batch.column("text")):
            tokens, signs, sizes, seen = [], [], [], set()
            for shingles in shingle_sets(batch.column("text").slice(low, high - low)):
                if len(shingles) and (sign := set_sign(shingles)) not in seen:
                    seen.add(sign)
                    tokens.append(shingles[:np.searchsorted(shingles, edge)])
                    signs.append(sign)
                    sizes.append(len(shingles))
            if tokens:
                held = [len(t) for t in tokens]
                yield pa.record_batch({"token": np.concatenate(tokens).view(np.int64), "sign": np.repeat(np.array(signs, np.int64), held),
                                       "n": np.repeat(np.array(sizes, np.int32), held)})


def _later(batches: Iterator[pa.RecordBatch], edge: np.uint64) -> Iterator[pa.RecordBatch]:
    """The first ``need`` shingles of each set above the border."""
    for batch in batches:
        signs, needs = batch.column("sign").to_pylist(), batch.column("need").to_pylist()
        for shingles, sign, need in zip(shingle_sets(batch.column("text")), signs, needs, strict=True):
            at = int(np.searchsorted(shingles, edge))
            tokens = shingles[at:at + need]
            if len(tokens):
                yield pa.record_batch({"token": tokens.view(np.int64), "node": np.full(len(tokens), sign)})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count vectors of 65,536 groups, as the group of each shingle; none for large sets."""
    for batch in batches:
        near = [(x >> np.uint64(48)).astype("<u2").tobytes() if len(x) <= NEAR else b"" for x in shingle_sets(batch.column("text"))]
        yield pa.record_batch({"node": batch.column("sign"), "near": pa.array(near, pa.binary())})


def _pairs_here(token: np.ndarray, sign: np.ndarray, n: np.ndarray, limit: int, percent: int):
    """Of whole runs of tokens: the pairs of sets that few share, by size similar enough, and the rows of the others."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    held = np.diff(np.append(first, len(token)))
    a, b = [], []
    for m in range(2, min(limit, int(held.max())) + 1):
        at = first[held == m]
        if len(at):
            i, j = np.triu_indices(m, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            like = percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y])
            a.append(sign[x[like]])
            b.append(sign[y[like]])
    many = np.repeat(held > limit, held)
    return a, b, sign[many], token[many]


def _shared(batches: Iterator[pa.RecordBatch], limit: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and sign: pairs ``a < b`` of sets that meet where few do, and ``sign, token`` where many do."""
    a, b, size = [], [], 0
    rest = (np.zeros(0, np.int64),) * 3  # rows of the last token, which may go on
    open_ = None  # the last token and sign if many sets have the token

    def batch_of(x: np.ndarray, y: np.ndarray, many: bool) -> pa.RecordBatch:
        return pa.record_batch({"a": x, "b": y, "many": np.full(len(x), many)})

    def distinct() -> pa.RecordBatch:
        x, y = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return batch_of(x[new], y[new], False)

    for batch in chain(batches, [None]):
        token, sign, n = rest
        if batch is not None:
            token, sign, n = (np.concatenate([x, batch.column(c).to_numpy().astype(np.int64)]) for c, x in zip(("token", "sign", "n"), rest, strict=True))
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sign[1:] != sign[:-1])
        new[0] = open_ != (token[0], sign[0])
        token, sign, n = token[new], sign[new], n[new]
        if open_ is not None:
            on = int(np.searchsorted(token, open_[0], side="right"))
            if on:
                yield batch_of(sign[:on], token[:on], True)
                open_ = (open_[0], sign[on - 1])
            token, sign, n = token[on:], sign[on:], n[on:]
        rest = (token[:0], sign[:0], n[:0])
        if not len(token):
            continue
        if batch is not None:
            last = int(np.searchsorted(token, token[-1]))
            if len(token) - last > limit:
                open_ = (token[-1], sign[-1])
            else:
                rest = (token[last:], sign[last:], n[last:])
                token, sign, n = token[:last], sign[:last], n[:last]
        if len(token):
            x, y, many, where = _pairs_here(token, sign, n, limit, percent)
            if len(many):
                yield batch_of(many, where, True)
            a, b, size = a + x, b + y, size + sum(map(len, x))
        if size > 1 << 20:
            yield distinct()
            a, b, size = [], [], 0
    if size:
        yield distinct()


class CountTree:
    """R-tree over count vectors, packed by size; boxes keep their largest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        first, last = labels[self.order], labels[self.order]
        self.levels = [(top, low, high, first, last)]
        while len(top) > LEAF:
            cut = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)
            self.levels.append((top, low, high, first, last))

    def search(self, point: np.ndarray, size: int, label: int, percent: int) -> np.ndarray:
        """Points of another label whose overlap with ``point`` may reach the similarity."""
        at = np.arange(len(self.levels[-1][0]))
        for depth, (top, low, high, first, last) in enumerate(reversed(self.levels)):
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(top)]
            at = at[(100 * low[at] <= 0) | (percent * low[at] <= 100 * size)]
            at = at[(percent * size <= 100 * high[at]) & ((first[at] != label) | (last[at] != label))]
            bound = np.minimum(top[at], point).sum(1)
            at = at[(100 + percent) * bound >= percent * (size + low[at])]
        return self.order[at]


class Near:
    """Count vectors of 65,536 groups of the sets of a cell, each given by the groups of its shingles.

    ``firsts`` are the first tokens at which each set meets others: a pair with one of them before
    ``token`` in common is listed there.
    """

    def __init__(self, near: list[bytes], sizes: np.ndarray, firsts: list[list[int]], token: int):
        self.groups, self.sizes = [np.frombuffer(x, "<u2") for x in near], sizes
        self.before = [{x for x in some if x < token} for some in firsts]
        self.held = np.zeros(1 << 16, bool)

    def among(self, i: int, j: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``j`` of which enough shingles lie in groups that ``i`` has too."""
        j = np.array([x for x in j if self.before[i].isdisjoint(self.before[x])], np.int64)
        known = np.array([len(self.groups[x]) > 0 for x in j], bool)
        if not len(self.groups[i]) or not known.any():
            return j
        far, j = j[~known], j[known]
        self.held[self.groups[i]] = True
        edge = np.cumsum([0] + [len(self.groups[x]) for x in j[:-1]])
        bound = np.add.reduceat(self.held[np.concatenate([self.groups[x] for x in j])], edge, dtype=np.int64)
        self.held[self.groups[i]] = False
        return np.concatenate([far, j[(100 + percent) * bound >= percent * (self.sizes[i] + self.sizes[j])]])


def _first_pairs(node, size, points, near: Near, percent: int) -> Iterator[tuple[int, int]]:
    """For each set the first one of the cell, in order of size, or else the one before it."""
    order = np.lexsort((node, size))
    ranked, node, size, points = order, node[order], size[order], points[order]
    one = np.arange(1, len(node))
    for back in (False, True):
        other = one - 1 if back else np.zeros(len(one), np.int64)
        bound = np.minimum(points[one], points[other]).sum(1)
        hit = (100 + percent) * bound >= percent * (size[one] + size[other])
        for i in np.flatnonzero(hit):
            hit[i] = len(near.among(ranked[one[i]], ranked[other[i:i + 1]], percent)) > 0
        yield from zip(node[one[hit]].tolist(), node[other[hit]].tolist(), strict=True)
        one = one[~hit]
        if not len(one):
            return


def _open_pairs(node, size, points, label, side, own, near: Near, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of different labels whose overlap may reach the similarity.

    Pairs of one side of the cell, and of two sets that meet in a higher band, are left to other cells.
    """
    if len(node) <= DIRECT:
        i, j = np.triu_indices(len(node), 1)
        ask = percent * np.maximum(size[i], size[j]) <= 100 * np.minimum(size[i], size[j])
        ask &= (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (own[i] | own[j])
        i, j = i[ask], j[ask]
        bound = np.minimum(points[i], points[j]).sum(1)
        hit = (100 + percent) * bound >= percent * (size[i] + size[j])
        for x, y in zip(i[hit], j[hit], strict=True):
            if len(near.among(x, np.array([y]), percent)):
                yield int(node[x]), int(node[y])
        return
    tree = CountTree(points, size, label)
    for i in range(len(node)):
        j = tree.search(points[i], size[i], label[i], percent)
        j = near.among(i, j[(j > i) & ((side[i] != side[j]) | (side[i] == 2)) & (own[i] | own[j])], percent)
        yield from ((int(node[i]), x) for x in node[j].tolist())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of each (token, cell, level) of a partition sorted by these, points folded to the level."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if not held:
            continue
        table = pa.Table.from_batches(held)
        key = np.stack([table.column(c).to_numpy() for c in ("token", "cell", "level")])
        edge = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [key.shape[1]]])
        if batch is not None:
            edge = edge[:-1]  # the last group may go on
        values = {c: table.column(c).to_numpy() for c in ("node", "n", "component", "side", "band")}
        point, near, firsts = (table.column(c).to_pylist() if len(edge) > 1 else [] for c in ("point", "near", "firsts"))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                level = int(key[2, a])
                points = np.stack([folded(p, 1 << level) for p in point[a:b]])
                yield tuple(values[c][a:b] for c in ("node", "n", "component", "side")) + (values["band"][a:b] == level, points, Near(near[a:b], values["n"][a:b], firsts[a:b], int(key[0, a])))
        held = table.slice(int(edge[-1])).to_batches() if batch is not None else []


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the set named by ``sign``, one of each run of them.

    Rows of one document come together, so repeated rows do not multiply the pairs.
    """
    last = None
    for batch in batches:
        keep = []
        for shingles, sign in zip(shingle_sets(batch.column("text")), batch.column("sign").to_pylist(), strict=True):
            keep.append(sign != last and set_sign(shingles) == sign)
            last = sign if keep[-1] else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, again: bool) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for node, size, label, side, own, points, near in _groups(batches):
        found = _open_pairs(node, size, points, label, side, own, near, percent) if again else _first_pairs(node, size, points, near, percent)
        for x, y in found:
            a.append(x)
            b.append(y)
        if len(a) > 50_000:
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _cells(met: DataFrame, points: DataFrame, percent: int, again: bool) -> DataFrame:
    """Cut the sets that meet at one token into cells of bounded size and like sizes.

    A set meets those of its own band, and those of the band below if it is short enough to be
    similar to one; two bands apart nothing is similar.  Where many meet, they are cut in parts: in
    the first round a cell is one part, in the second the parts meet pair by pair, and ``side`` says
    which of the two a set is from (2: a cell of one part).
    """
    parts = met.groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > CELL).select(
        "token", F.ceil(F.col("held") / CELL).cast("long").alias("parts"))
    cut = met.join(parts, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    if again:
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(
            (F.least(o, F.col("part")) * F.col("parts") + F.greatest(o, F.col("part"))).alias("cell"),
            F.when(o == F.col("part"), 2).when(F.col("part") < o, 0).otherwise(1).cast("long").alias("side")))
        cut = cut.select("token", "node", "component", F.explode(others).alias("c")).select("token", "node", "component", "c.cell", "c.side")
    else:
        cut = cut.select("token", "node", "component", F.col("part").alias("cell"), F.lit(2).cast("long").alias("side"))
    below = (F.col("band") > LEAST_BAND) & (F.col("n") * percent <= F.lit(100) * F.pow(F.lit(2.0), F.col("band") + 1))
    return cut.join(points, "node").withColumn(
        "level", F.explode(F.when(below, F.array("band", F.col("band") - 1)).otherwise(F.array("band"))))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, two in zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")), strict=True):
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _candidate_pairs(met: DataFrame, points: DataFrame, sets: DataFrame, percent: int, again: bool) -> DataFrame:
    """``a, b`` with a < b.  In the first round each set has one pair at most, with the least of its candidates."""
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _cells(met, points, percent, again)
    pairs = rows.repartition(tasks, "token", "cell", "level").sortWithinPartitions("token", "cell", "level").mapInArrow(
        partial(_candidates, percent=percent, again=again), "a long, b long").distinct()
    pairs = _bounded(pairs, sets, percent)
    if not again:
        pairs = pairs.groupBy("a").agg(F.min("b").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bound with one group for four shingles keeps."""
    a = sets.select(F.col("sign").alias("a"), F.col("fine").alias("fine_a"))
    b = sets.select(F.col("sign").alias("b"), F.col("fine").alias("fine_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(partial(_finer, percent=percent), "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose texts are similar."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(partial(_verified, percent=percent), "a long, b long")


def meeting_points(meetings: DataFrame) -> DataFrame:
    """``token``: one for all tokens at which the same sets meet."""
    lists = meetings.groupBy("token").agg(
        F.min("sign").alias("least"), F.max("sign").alias("most"), F.count("*").alias("held"),
        F.sum(F.shiftrightunsigned("sign", 32)).alias("high"), F.sum(F.col("sign").bitwiseAND(F.lit(2**32 - 1))).alias("low")).where("least < most")
    return lists.groupBy("held", "least", "most", "high", "low").agg(F.min("token").alias("token")).select("token")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, share: float | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row for each row of ``docs``.

    Documents link when 100 times the overlap of their sets is at least ``percent`` times their
    union; a component is named by its smallest ``doc_id``.  ``share`` of the shingles are listed by
    every set, the others as far as a set needs them; the result does not depend on it.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edge = border(percent, share)
    source = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    profiles = stage(source.mapInArrow(partial(_profiles, edge=edge), "node long, n long, below long, sign long, band long, point binary, fine binary"),
                     "jaccard-profiles")
    named = profiles.where("node is not null and n > 0")
    sets = stage(named.groupBy("sign").agg(F.min("node").alias("first"), *(F.first(c).alias(c) for c in ("n", "below", "band", "point", "fine"))),
                 "jaccard-sets")
    classes = sets.select("sign", "first")

    # from here on a set stands for its documents, and its sign is its node
    listed = source.where("node is not null").mapInArrow(partial(_listed, edge=edge), "token long, sign long, n int")
    shared = stage(listed.repartition(tasks, "token").sortWithinPartitions("token", "sign").mapInArrow(
        partial(_shared, limit=LEAF, percent=percent), "a long, b long, many boolean"), "jaccard-shared")
    few = stage(_bounded(shared.where("not many").select("a", "b").distinct(), sets, percent), "jaccard-few")
    common = shared.where("many").select(F.col("a").alias("sign"), F.col("b").alias("token"))
    needs = sets.select("sign", "first", "n", "below").join(common.groupBy("sign").agg(F.count("*").alias("common")), "sign", "left")
    needs = needs.withColumn("need", _prefix_size(F.col("n"), percent) - F.col("below") + F.coalesce("common", F.lit(0)))
    needs = stage(needs.where("need > 0").select("sign", "need", (F.col("need") > F.col("n") - F.col("below")).alias("all")), "jaccard-needs")

    live = few.select(F.col("a").alias("sign")).unionByName(few.select(F.col("b").alias("sign"))).distinct().withColumn("need", F.lit(0).cast("long"))
    live = live.unionByName(needs.select("sign", "need")).groupBy("sign").agg(F.max("need").alias("need")).join(classes, "sign")
    texts = source.join(live.withColumnRenamed("first", "node"), "node").select("sign", "need", "text")
    own_texts = stage(texts.mapInArrow(_own_texts, "sign long, need long, text string"), "jaccard-texts")
    texts = own_texts.select(F.col("sign").alias("node"), "text")
    late = own_texts.where("need > 0")
    meetings = late.mapInArrow(partial(_later, edge=edge), "token long, node long").unionByName(
        common.join(needs.where("all"), "sign", "left_semi").select("token", F.col("sign").alias("node")))
    meetings = stage(meetings.distinct(), "jaccard-later")
    points_of = meeting_points(meetings.withColumnRenamed("node", "sign"))
    met = stage(meetings.join(points_of, "token").select("token", "node"), "jaccard-met")
    points = late.join(met.select(F.col("node").alias("sign")).distinct(), "sign", "left_semi").select("sign", "text").distinct()
    points = points.mapInArrow(_near, "node long, near binary").groupBy("node").agg(F.min("near").alias("near"))
    points = points.join(met.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("token")), 1, FIRSTS).alias("firsts")), "node")
    points = stage(points.join(sets.select(F.col("sign").alias("node"), "n", "band", "point"), "node"), "jaccard-points")

    tried = stage(_candidate_pairs(met.withColumn("component", F.col("node")), points, sets, percent, False).unionByName(few).distinct(), "jaccard-pairs")
    first = stage(_links(tried, texts, percent), "jaccard-links")
    known = stage(components(first), "jaccard-known")
    open_ = met.join(known, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
    several = stage(open_.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                    .where("x < y").select("token"), "jaccard-open")
    rest = _candidate_pairs(open_.join(several, "token"), points, sets, percent, True).join(tried, ["a", "b"], "left_anti")
    second = stage(_links(stage(rest, "jaccard-pairs"), texts, percent), "jaccard-links")
    found = components(first.unionByName(second)).withColumnRenamed("node", "sign").join(classes, "sign")
    found = stage(found, "jaccard-components")
    heads = found.groupBy("component").agg(F.min("first").alias("head"))
    moved = found.join(heads, "component").select("sign", "head")
    ids = classes.join(moved, "sign", "left").select("sign", F.coalesce("head", "first").alias("component"))
    own = profiles.select("node", "n", "sign")
    rows = own.where("n > 0 and node is not null").join(ids, "sign").select("node", "n", "component")
    rest = own.where("n = 0 or node is null").select("node", "n", F.col("node").alias("component"))
    return rows.unionByName(rest).select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def twin(percent: int = PERCENT) -> str:
    """The same rows in DuckDB SQL, on shingles as text and links spelled out; for unique ids."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS p FROM d WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS k FROM places),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= {percent} * (na.n + nb.n - shared)),
    sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
    JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""
