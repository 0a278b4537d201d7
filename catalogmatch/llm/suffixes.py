"""Removal of repeated byte strings by a distributed difference-cover suffix order.

Sorting every suffix of a corpus moves it many times over, so the string that is sorted is made of
phrases.  A phrase begins at an *anchor*: the byte with the least hash of its next eight bytes among
``tau`` neighbours.  Whether and where the next anchor follows is decided by the ``tau + 8`` bytes from
an anchor on, so equal strings of ``window`` bytes have the same anchors inside, whatever their offset.

0. *Copies.*  A text that is found twice is a repeat as a whole; one of its copies takes part below.
1. *Candidates.*  All windows that begin up to a given anchor hold the ``window - tau + 1`` bytes after
   it, their core.  Anchors whose core is found once in the corpus are left alone from here on.
2. *Sort sampled triples.*  Of the anchors of a text those with a number not divisible by three are
   sampled.  Their triple is the string from the anchor to the end of what decides its third phrase;
   distinct triples are sorted as bytes and named by their place.
3. *Recurse on names.*  The triples of names of the anchors 3, 9, 27 ... apart are sorted and named in
   the same way, until every name that several anchors share covers a window.
4. *Merge remaining suffixes.*  The suffix at the first window of an anchor is its bytes up to a sampled
   anchor at most two further on, then that anchor's name.  For two texts cut differently one of the
   three distances, the difference cover, serves both; so each suffix enters the order twice.
5. *Compare adjacent prefixes.*  In that order, neighbours that agree on all windows of their anchors
   settle them.  Windows at the two ends of a repeat, which agree with others only in part, are
   compared one by one by their own bytes, with those others that have the same core.

Every order is a range partitioning of distinct strings counted before; no group of texts is gathered,
and lists go back to a text by its hash, so none outgrows one text.  Bitmaps (``bits``) of
bounded size spare needless rows; joins decide.

Defined results: a null text is empty and has no bytes; texts shorter than ``window`` stay whole; rows
that are alike in id and text count as several and lose the same bytes; ids do not matter, so rows
without one are like others; an empty table gives no rows; other columns are ignored.  Strings are
compared by 64-bit hashes.  Working memory is about 150 bytes per byte of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm import bits
from catalogmatch.llm import words as w
from catalogmatch.llm.letters import whole
from catalogmatch.llm.staging import stage

WINDOW = 200
GRAM = 8
SLICE = 1 << 20
_LETTER = w.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_CORE, _TRIPLE, _SUFFIX, _GROUP, _SINGLE = (np.uint64(i) << np.uint64(56) for i in range(1, 6))


def tau_for(window: int) -> int:
    """Neighbours among which an anchor has the least hash; three phrases and their ends fit in a window."""
    return (window - GRAM) // 3


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=2)
def _numbers(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.uint64)


class _Slice:
    """Anchors of a slice of texts, and the hashes of byte ranges in it."""

    def __init__(self, texts: pa.Array, window: int):
        self.window, self.tau = window, tau_for(window)
        self.data, self.at = whole(texts)
        n, tau = len(self.data), self.tau
        size = 1 << max(n, 1).bit_length()
        self._inverse = _powers(pow(_BASE, -1, 1 << 64), size + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[self.data] * _powers(_BASE, size + 1)[:n], dtype=np.uint64, out=self._sums[1:])
        reach = tau + GRAM - 1
        usable = np.maximum(np.diff(self.at) - reach + 1, 0)
        if n < reach or not usable.any():
            start = np.zeros(0, np.int64)
            least = np.zeros(0, np.uint64)
        else:
            gram = np.empty(n - GRAM + 1, np.uint64)
            for k in range(GRAM):
                part = np.frombuffer(self.data, "<u8", count=(n - k) // GRAM, offset=k)
                gram[k::GRAM] = part
            gram *= np.uint64(_BASE)  # the upper half of the product is the hash, the lower half gives way to the place
            gram &= np.uint64(0xFFFFFFFF00000000)
            gram |= _numbers(size + 1)[:len(gram)]
            edge = np.zeros(n + 1, np.int8)
            edge[self.at[:-1][usable > 0]] = 1
            stops = (self.at[:-1] + usable)[usable > 0]
            edge[stops] -= 1
            start = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
            least = w.lowest(gram, tau)[start] & np.uint64(0xFFFFFFFF)
        first = np.ones(len(start), bool)
        first[1:] = least[1:] != least[:-1]
        at = np.flatnonzero(first)
        self.anchor = least[at].astype(np.int64)
        self.low = start[at]
        self.high = start[np.append(at[1:], len(start))[:len(at)] - 1] if len(at) else self.low
        self.text = np.searchsorted(self.at, self.anchor, side="right") - 1
        self.end = self.at[self.text + 1]
        self.begin = np.searchsorted(self.text, np.arange(len(self.at)))  # first anchor of each text
        self.number = np.arange(len(at)) - self.begin[self.text]
        self.last = np.minimum(self.high, self.end - window)  # last window of the anchor
        self.windowed = self.low <= self.last

    def hash(self, start: np.ndarray, end: np.ndarray, kind: np.uint64) -> np.ndarray:
        span = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return w.mix(w.mix(span ^ (end - start).astype(np.uint64)) ^ kind)

    def cores(self) -> np.ndarray:
        """Core of each anchor that has windows (of the others: of what there is)."""
        return self.hash(self.anchor, np.minimum(self.anchor + self.window - self.tau + 1, self.end), _CORE)

    def shape(self) -> np.ndarray:
        """How far an anchor is from its first window, and that from the last."""
        return (self.anchor - self.low).astype(np.uint64) << np.uint64(16) | np.maximum(self.last - self.low, 0).astype(np.uint64)

    def groups(self) -> np.ndarray:
        """Hash of all windows of each anchor, with their places around it; of no use for anchors without windows."""
        stop = np.where(self.windowed, self.last + self.window, self.low)
        return w.mix(self.hash(self.low, stop, _GROUP) ^ w.mix(self.shape()))

    def needed(self, candidate: np.ndarray) -> np.ndarray:
        """Anchors whose names order the suffixes of the candidates up to a window's length."""
        at = np.flatnonzero(candidate)
        stop = np.minimum(np.searchsorted(self.anchor, self.anchor[at] + self.window, side="right"), self.begin[self.text[at] + 1])
        stop = np.maximum(stop, np.minimum(at + 3, self.begin[self.text[at] + 1]))
        edge = np.zeros(len(self.anchor) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, stop, -1)
        return np.cumsum(edge[:-1]) > 0

    def triples(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte range of the triple of each anchor in ``at``."""
        third = np.minimum(at + 2, len(self.anchor) - 1)
        same = (at + 2 < len(self.anchor)) & (self.text[third] == self.text[at])
        return self.anchor[at], np.where(same, np.minimum(self.anchor[third] + self.tau + GRAM, self.end[at]), self.end[at])


def _slices(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, _Slice]]:
    texts = batch.column("text")
    for low, high in w.slices(texts, SLICE):
        yield low, high, _Slice(texts.slice(low, high - low), window)


def _counted(name: str, hashes: list[np.ndarray]) -> pa.RecordBatch:
    h, c = np.unique(np.concatenate(hashes), return_counts=True)
    return pa.record_batch({name: h.view(np.int64), "c": c.astype(np.int64)})


def _once(batches: Iterator[pa.RecordBatch], copies) -> Iterator[pa.RecordBatch]:
    """Rows whose text surely has no copy; all where ``copies`` is None."""
    for batch in batches:
        yield batch if copies is None else batch.filter(pa.array(~bits.member(copies.value, batch.column("key").to_numpy().view(np.uint64))))


def _cores(batches: Iterator[pa.RecordBatch], window: int, copies) -> Iterator[pa.RecordBatch]:
    for batch in _once(batches, copies):
        held = [x.cores()[x.windowed] for _, _, x in _slices(batch, window)]
        if held:
            yield _counted("core", held)


def _candidates(x: _Slice, cores) -> np.ndarray:
    return x.windowed & bits.member(cores.value, x.cores())


def _hopeful(batches: Iterator[pa.RecordBatch], window: int, cores, copies) -> Iterator[pa.RecordBatch]:
    """The rows whose text has a candidate."""
    for batch in _once(batches, copies):
        keep = np.zeros(batch.num_rows, bool)
        for low, _, x in _slices(batch, window):
            keep[low + x.text[_candidates(x, cores)]] = True
        if keep.any():
            yield batch.filter(pa.array(keep))


def _sampled(x: _Slice, cores) -> np.ndarray:
    return np.flatnonzero(x.needed(_candidates(x, cores)) & (x.number % 3 != 0))


def _triples(batches: Iterator[pa.RecordBatch], window: int, cores) -> Iterator[pa.RecordBatch]:
    """``triple, bytes, c``: the strings of the sampled triples, each once in a slice with its count."""
    for batch in batches:
        for _, _, x in _slices(batch, window):
            start, end = x.triples(_sampled(x, cores))
            h, first, c = np.unique(x.hash(start, end, _TRIPLE), return_index=True, return_counts=True)
            start, size = start[first], (end - start)[first]
            offsets = np.append(0, np.cumsum(size))
            place = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
            strings = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(h), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(x.data[place])])
            yield pa.record_batch({"triple": h.view(np.int64), "bytes": strings.cast(pa.binary()), "c": c.astype(np.int32)})


def _places(batches: Iterator[pa.RecordBatch], window: int, cores) -> Iterator[pa.RecordBatch]:
    """``key, number, at, triple`` of the sampled anchors."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for low, _, x in _slices(batch, window):
            at = _sampled(x, cores)
            start, end = x.triples(at)
            yield pa.record_batch({
                "key": keys[low + x.text[at]], "number": x.number[at].astype(np.int32),
                "at": x.anchor[at] - x.at[x.text[at]], "triple": x.hash(start, end, _TRIPLE).view(np.int64)})


def _flat(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row and fields of the structs in a list column, sorted by row and number."""
    rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    fields = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    order = np.lexsort((fields["number"], rows))
    return rows[order], {k: v[order] for k, v in fields.items()}


_NUMBERS = 1 << 31


def _at(place: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted places are in the sorted ``place``, and which of them are there."""
    if not len(place):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
    return i, place[i] == wanted


def _names(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Place (row and number) and name of every sampled anchor: ``name`` of its triple, then ``finer`` (0: none)."""
    row, f = _flat(batch.column("names"))
    f |= {"row": row, "finer": np.zeros(len(row), np.int64), "more": f["shared"]}
    place = row * _NUMBERS + f["number"]
    if "finer" in batch.schema.names:
        own, g = _flat(batch.column("finer"))
        i, _ = _at(place, own * _NUMBERS + g["number"])
        f["more"] = np.zeros(len(row), bool)
        f["finer"][i], f["more"][i] = g["name"], g["more"]
    return place, f


def _longer(batches: Iterator[pa.RecordBatch], window: int, step: int) -> Iterator[pa.RecordBatch]:
    """Names of three anchors ``step`` apart, -1 beyond the end, of the anchors that need longer ones.

    ``open`` tells whether the three names together may still end inside a window.
    """
    for batch in batches:
        place, f = _names(batch)
        need = f["more"].copy()
        if step == 3:
            i, there = _at(place, place + step)
            need &= there & (f["at"][i] <= f["at"] + window)
        at = np.flatnonzero(need)
        out = {"key": batch.column("key").to_numpy()[f["row"][at]], "number": f["number"][at].astype(np.int32), "a": f["name"][at], "a2": f["finer"][at]}
        for name, ahead in (("b", step), ("c", 2 * step)):
            i, there = _at(place, place[at] + ahead)
            out[name], out[name + "2"] = (np.where(there, f[x][i], -1) for x in ("name", "finer"))
        i, there = _at(place, place[at] + 3 * step)
        out["open"] = there & (f["at"][i] <= f["at"][at] + window)
        yield pa.record_batch(out)


def suffix_names(hopeful: DataFrame, cores, window: int = WINDOW) -> DataFrame:
    """``key, names, finer``: of each text its sampled anchors with the names that order their suffixes.

    ``names`` has the number of the anchor, its place ``at`` and the ``name`` of its triple; ``finer`` orders those
    of one name that need it.
    """
    option = {"window": window, "cores": cores}
    places = hopeful.mapInArrow(partial(_places, **option), "key long, number int, at long, triple long")
    strings = hopeful.mapInArrow(partial(_triples, **option), "triple long, bytes binary, c int")
    order = strings.groupBy("triple").agg(F.min("bytes").alias("bytes"), F.sum("c").alias("c"))
    order = order.repartitionByRange("bytes").sortWithinPartitions("bytes")
    triples = stage(order.select("triple", (F.col("c") > 1).alias("shared"), F.monotonically_increasing_id().alias("name")), "suffix-triples")
    one = F.struct("number", "at", "name", "shared")
    named = stage(places.join(triples, "triple").groupBy("key").agg(F.collect_list(one).alias("names")), "suffix-places")
    done, finer, step = [], None, 3
    while True:
        known = named if finer is None else named.join(finer, "key")
        three = ["a", "a2", "b", "b2", "c", "c2"]
        rows = known.mapInArrow(partial(_longer, window=window, step=step), "key long, number int, " + ", ".join(f"{x} long" for x in three) + ", open boolean")
        order = rows.groupBy(three).agg(F.count("*").alias("n"), F.max("open").alias("open")).repartitionByRange(*three).sortWithinPartitions(*three)
        names = stage(order.select(*three, (F.monotonically_increasing_id() + 1).alias("name"), ((F.col("n") > 1) & F.col("open")).alias("open")), "suffix-names")
        # names of one triple are refined together as long as one of them needs it, so they can be compared
        again = names.groupBy("a").agg(F.max("open").alias("more"))
        own = rows.join(names.drop("open").join(again, "a"), three).select("key", F.struct("number", "name", "more").alias("one"))
        if finer is not None:  # those refined before and not now keep their names
            own = own.unionByName(finer.select("key", F.explode("finer").alias("one")).where("not one.more"))
        lists = stage(own.groupBy("key").agg(F.collect_list("one").alias("finer"), F.max("one.more").alias("more")), "suffix-finer")
        done.append(lists.where("not more").drop("more"))
        finer, step = lists.where("more").drop("more"), 3 * step
        if not names.where("open").limit(1).count():
            return named.join(reduce(DataFrame.unionByName, done), "key", "left")


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, cores) -> Iterator[pa.RecordBatch]:
    """``left, name, finer, windows, c``: per candidate and distance to a sampled anchor, its remaining suffix and its windows."""
    for batch in batches:
        for low, high, x in _slices(batch, window):
            place, f = _names(batch.slice(low, high - low))
            candidate, group, shape = np.flatnonzero(_candidates(x, cores)), x.groups(), x.shape()
            out = []
            for ahead in range(3):
                at = candidate[(x.number[candidate] + ahead) % 3 != 0]
                at = at[at + ahead < x.begin[x.text[at] + 1]]
                i, _ = _at(place, x.text[at] * _NUMBERS + x.number[at] + ahead)
                left = w.mix(x.hash(x.low[at], x.anchor[at + ahead], _SUFFIX) ^ w.mix(shape[at] * np.uint64(3) + np.uint64(ahead)))
                out.append(np.stack([left.view(np.int64), f["name"][i], f["finer"][i], group[at].view(np.int64)], axis=1))
            every = np.concatenate(out)
            if len(every):
                every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
                first = np.ones(len(every), bool)
                first[1:] = (every[1:] != every[:-1]).any(1)
                c = np.diff(np.append(np.flatnonzero(first), len(every)))
                columns = {name: every[first, i].copy() for i, name in enumerate(("left", "name", "finer", "windows"))}
                yield pa.record_batch(columns | {"c": c.astype(np.int64)})


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbours with the same windows: their number ``c``, and whether they touch a border of the partition."""
    held, c, edge = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        left, windows, counts = (batch.column(name).to_numpy() for name in ("left", "windows", "c"))
        first = np.ones(len(windows), bool)
        first[1:] = (windows[1:] != windows[:-1]) | (left[1:] != left[:-1])
        at = np.flatnonzero(first)
        runs, sums = np.stack([left[at], windows[at]]), np.add.reduceat(counts, at)
        if held is not None and (held == runs[:, 0]).all():
            sums[0] += c
        elif held is not None:
            runs, sums = np.concatenate([held[:, None], runs], axis=1), np.append(c, sums)
        edges = np.zeros(runs.shape[1], bool)
        edges[0] = edge
        yield pa.record_batch({"left": runs[0, :-1].copy(), "windows": runs[1, :-1].copy(), "c": sums[:-1], "edge": edges[:-1]})
        held, c, edge = runs[:, -1], int(sums[-1]), edge and runs.shape[1] == 1
    if held is not None:
        yield pa.record_batch({"left": held[:1], "windows": held[1:], "c": np.array([c], np.int64), "edge": np.ones(1, bool)})


def _known(lists: pa.Array, text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values (sorted by ``text``) are in the list of their text."""
    out = np.zeros(len(values), bool)
    cuts = np.searchsorted(text, np.arange(len(lists) + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        if lists[i].is_valid:
            part = slice(cuts[i], cuts[i + 1])
            out[part] = np.isin(values[part], lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
    return out


def _settled_here(batches: Iterator[pa.RecordBatch], window: int, cores, settled) -> Iterator[pa.RecordBatch]:
    """``value, key``: what a text may find among the settled windows."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for low, _, x in _slices(batch, window):
            group = x.groups()
            at = np.flatnonzero(_candidates(x, cores))
            at = at[bits.member(settled.value, group[at])]
            yield pa.record_batch({"value": group[at].view(np.int64), "key": keys[low + x.text[at]]})


def _open(x: _Slice, cores, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that are settled, and those that are not."""
    at = np.flatnonzero(_candidates(x, cores))
    known = _known(lists, x.text[at], x.groups()[at])
    return at[known], at[~known]


def _open_cores(batches: Iterator[pa.RecordBatch], window: int, cores) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [x.cores()[_open(x, cores, batch.column("known").slice(low, high - low))[1]] for low, high, x in _slices(batch, window)]
        if held:
            yield _counted("core", held)


def _windows_of(x: _Slice, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of the anchors ``at``, their hashes and texts."""
    size = x.last[at] - x.low[at] + 1
    start = np.repeat(x.low[at] - np.append(0, np.cumsum(size)[:-1])[:len(at)], size) + np.arange(size.sum())
    return start, x.hash(start, start + x.window, _SINGLE), np.repeat(x.text[at], size)


def _singles(batches: Iterator[pa.RecordBatch], window: int, cores, open_cores) -> Iterator[pa.RecordBatch]:
    """``value, c, open``: windows of open candidates, and of settled ones that share a core with such."""
    for batch in batches:
        for low, high, x in _slices(batch, window):
            settled, still = _open(x, cores, batch.column("known").slice(low, high - low))
            settled = settled[bits.member(open_cores.value, x.cores()[settled])]
            for at, flag in ((settled, False), (still, True)):
                if len(at):
                    h, c = np.unique(_windows_of(x, at)[1], return_counts=True)
                    yield pa.record_batch({"value": h.view(np.int64), "c": c.astype(np.int64), "open": np.full(len(h), flag)})


def _singles_here(batches: Iterator[pa.RecordBatch], window: int, cores, found) -> Iterator[pa.RecordBatch]:
    """``value, key``: what a text may find among the single windows."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for low, high, x in _slices(batch, window):
            _, value, text = _windows_of(x, _open(x, cores, batch.column("known").slice(low, high - low))[1])
            some = bits.member(found.value, value)
            yield pa.record_batch({"value": value[some].view(np.int64), "key": keys[low + text[some]]})


def _lists(rows: DataFrame, values: DataFrame, name: str) -> DataFrame:
    return rows.join(values, "value").groupBy("key").agg(F.collect_set("value").alias(name))


def repeated(texts: DataFrame, window: int = WINDOW) -> tuple[DataFrame, object]:
    """``key, copied, known, single``: what repeats of the texts of ``texts(key, text)``, whose ``key`` is a hash of the text.

    ``copied`` texts are found more than once.  For the others there are the hashes of their repeated windows,
    by anchor and one by one; also returned is the bitmap of repeated cores, which marks the candidates.
    """
    context = texts.sparkSession.sparkContext

    def bitmap(values: DataFrame, column: str):
        return context.broadcast(bits.bitmap(values, column, bits.size_for(values.count())))

    copied = stage(texts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "suffix-copied")
    copies = bitmap(copied, "key")
    one = texts.mapInArrow(partial(_touched, touched=copies), "key long, text string").groupBy("key").agg(F.min("text").alias("text"))
    one = stage(one, "suffix-copies")

    def every(function, schema: str, **option) -> DataFrame:
        return texts.mapInArrow(partial(function, window=window, copies=copies, **option), schema).unionByName(
            one.mapInArrow(partial(function, window=window, copies=None, **option), schema))

    cores = every(_cores, "core long, c long")
    cores = bitmap(stage(cores.groupBy("core").agg(F.sum("c").alias("c")).where("c > 1").select("core"), "suffix-cores"), "core")
    option = {"window": window, "cores": cores}
    hopeful = stage(every(_hopeful, "key long, text string", cores=cores), "suffix-texts")
    rows = hopeful.join(suffix_names(hopeful, cores, window), "key").mapInArrow(
        partial(_suffixes, **option), "left long, name long, finer long, windows long, c long")
    place = ["left", "name", "finer"]
    order = rows.groupBy(*place, "windows").agg(F.sum("c").alias("c")).repartitionByRange(*place).sortWithinPartitions(*place)
    runs = stage(order.select("left", "windows", "c").mapInArrow(_adjacent, "left long, windows long, c long, edge boolean"), "suffix-runs")
    at_borders = runs.where("edge").groupBy("left", "windows").agg(F.sum("c").alias("c")).drop("left")
    settled = runs.select("windows", "c").unionByName(at_borders).where("c > 1").select(F.col("windows").alias("value")).distinct()
    settled = stage(settled, "suffix-settled")
    pairs = hopeful.mapInArrow(partial(_settled_here, **option, settled=bitmap(settled, "value")), "value long, key long")
    texts = stage(hopeful.join(_lists(pairs, settled, "known"), "key", "left").select("key", "text", "known"), "suffix-known")
    still = texts.select("text", "known").mapInArrow(partial(_open_cores, **option), "core long, c long").select("core").distinct()
    open_cores = bitmap(stage(still, "suffix-open"), "core")
    singles = texts.select("text", "known").mapInArrow(partial(_singles, **option, open_cores=open_cores), "value long, c long, open boolean")
    singles = singles.groupBy("value").agg(F.sum("c").alias("c"), F.max("open").alias("open")).where("c > 1 and open").select("value")
    singles = stage(singles, "suffix-singles")
    pairs = texts.mapInArrow(partial(_singles_here, **option, found=bitmap(singles, "value")), "value long, key long")
    lists = texts.where("known is not null").select("key", "known").join(_lists(pairs, singles, "single"), "key", "full")
    return stage(lists.join(copied.withColumn("copied", F.lit(True)), "key", "full"), "suffix-lists"), cores


def _removal(batches: Iterator[pa.RecordBatch], window: int, cores, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for low, high, x in _slices(batch, window):
            copied, known, single = (batch.column(name).slice(low, high - low).is_valid().to_numpy(zero_copy_only=False) for name in ("copied", "known", "single"))
            some = (known | single) & ~copied
            edge = np.zeros(len(x.data) + 1, np.int64)
            copied &= np.diff(x.at) >= window
            np.add.at(edge, x.at[:-1][copied], 1)
            np.add.at(edge, x.at[1:][copied], -1)
            if some.any():
                settled, still = _open(x, cores, batch.column("known").slice(low, high - low))
                settled = settled[some[x.text[settled]]]
                np.add.at(edge, x.low[settled], 1)
                np.add.at(edge, x.last[settled] + window, -1)
                still = still[some[x.text[still]]]
                start, value, text = _windows_of(x, still)
                start = start[_known(batch.column("single").slice(low, high - low), text, value)]
                np.add.at(edge, start, 1)
                np.add.at(edge, start + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            begins = x.at[:-1][x.at[:-1] < len(gone)]
            opens[begins] = gone[begins]
            removed, spans = (np.diff(np.append(0, np.cumsum(v))[x.at]) for v in (gone, opens))
            kept = [x.data[a:b][~gone[a:b]].tobytes() if n else x.data[a:b].tobytes() for a, b, n in zip(x.at[:-1], x.at[1:], removed, strict=True)]
            out = {"doc_id": ids.slice(low, high - low), "n_bytes": np.diff(x.at).astype(np.int64), "n_removed": removed.astype(np.int64), "n_spans": spans.astype(np.int64)}
            if digest:
                out["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())
            else:
                out["kept"] = pa.array(kept, pa.binary())
            yield pa.record_batch(out)


def _touched(batches: Iterator[pa.RecordBatch], touched) -> Iterator[pa.RecordBatch]:
    """Rows whose text may have lists."""
    for batch in batches:
        some = bits.member(touched.value, batch.column("key").to_numpy().view(np.uint64))
        if some.any():
            yield batch.filter(pa.array(some))


def _untouched(batches: Iterator[pa.RecordBatch], touched, digest: bool) -> Iterator[pa.RecordBatch]:
    """The other rows, which stay whole."""
    for batch in batches:
        batch = batch.filter(pa.array(~bits.member(touched.value, batch.column("key").to_numpy().view(np.uint64))))
        data, at = whole(batch.column("text"))
        zero = np.zeros(batch.num_rows, np.int64)
        out = {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(at).astype(np.int64), "n_removed": zero, "n_spans": zero}
        kept = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        if digest:
            out["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())
        else:
            out["kept"] = pa.array(kept, pa.binary())
        yield pa.record_batch(out)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and the remaining bytes as ``kept``.

    A byte goes if a string of ``window`` bytes (32 at least) that covers it also starts anywhere else.
    ``digest`` gives ``kept_sha256`` in place of the bytes, which may end inside a character.
    """
    if window < 32:
        raise ValueError("windows of fewer than 32 bytes are not supported")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    lists, cores = repeated(rows.select("key", "text"), window)
    touched = docs.sparkSession.sparkContext.broadcast(bits.bitmap(lists, "key", bits.size_for(lists.count())))
    last = ("kept_sha256 string", "kept_sha256") if digest else ("kept binary", "kept")
    columns = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last[0]}"
    removal = partial(_removal, window=window, cores=cores, digest=digest)
    # texts without lists need not be moved to where lists are
    whole_rows = rows.mapInArrow(partial(_untouched, touched=touched, digest=digest), columns)
    some = rows.mapInArrow(partial(_touched, touched=touched), "doc_id long, text string, key long").join(lists, "key", "left")
    return whole_rows.unionByName(some.select("doc_id", "text", "copied", "known", "single").mapInArrow(removal, columns))
