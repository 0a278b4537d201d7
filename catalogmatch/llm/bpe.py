"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The symbols of a pre-token are the leaves; each leaf holds the rank of the merge of its symbol with
the next one, and every inner node the least value below it.  The root therefore names the leftmost
pair of the lowest rank.  A merge changes three leaves, each in logarithmic time, and the work ends
when the root holds no mergeable pair.  So one long pre-token costs n log n, not n squared.

Pre-tokens of a batch of texts are found at once: kinds of neighbouring letters say where one starts, so no
Python string is made for each.  The batch's distinct ones are looked up, and their ids dealt to all places.
Short pre-tokens not met before are merged many at a time: one NumPy array holds their trees side by
side, and every step takes the root of each tree and updates its leaves.  Longer ones take the same
steps one by one.

The vocabulary file is read once by the driver (its size is a property of the tokenizer, a few MB)
and broadcast.  Rows are independent: no shuffle, one Arrow batch at a time.  Each worker remembers
the ids of short pre-tokens in a table of bounded size; forgetting costs time only.

Defined results: a null text is the empty text, which has no tokens; the added tokens of the
vocabulary are found in texts as the tokenizers library finds them; repeated rows give repeated
results; an empty table gives no rows; other columns, whatever their names, are ignored.  A text of any length
is encoded whole; memory is in proportion to the longest text, and to 2 MB of texts beside it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from catalogmatch.llm.words import slices

REMEMBERED = 300_000  # in each of two tables
REMEMBERED_CHARS = 64

# ---- fixed values: the public pre-token pattern of byte-level BPE ----
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ---- end of fixed values ----

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)  # the kinds of letters that the pattern tells apart
_SHORT = np.isin(np.arange(128), [ord(c) for c in "stmd"])  # after an apostrophe: 's 't 'm 'd
_LONG = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}

_NONE = 1 << 62
_BLANK = np.int32(2**31 - 1)
_WIDTHS = (8, 16, 32, 64)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def merge(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply ``merges`` (pair to rank and new symbol), always the leftmost pair of the lowest rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        found = merges.get((sym[i], sym[i + 1]))
        if found:
            tree[width + i] = found[0] << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    while (least := tree[1]) != _NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        sym[i] = merges[sym[i], sym[j]][1]
        sym[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        changed = [(j, _NONE)]
        for left in (before[i], i):
            if left >= 0:
                right = after[left]
                found = merges.get((sym[left], sym[right])) if right < n else None
                changed.append((left, found[0] << 32 | left if found else _NONE))
        for leaf, value in changed:
            k = width + leaf
            if tree[k] == value:
                continue
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a <= b else b
                if tree[k] == value:
                    break
                tree[k] = value
                k >>= 1
    return [s for s in sym if s >= 0]


def merge_rows(symbols: np.ndarray, width: int, pairs: Pairs) -> np.ndarray:
    """:func:`merge` for many short rows: ``symbols`` is rows by ``width`` (a power of two), -1 after the end.

    Gives the same matrix with merged symbols in place and -1 where a symbol went into another.
    """
    n = len(symbols)
    sym = np.full((n, width + 1), -1, np.int32)
    sym[:, :width] = symbols
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
    place = np.arange(width, dtype=np.int32)
    tree = np.full((n, 2 * width), _BLANK, np.int32)
    rank = pairs.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width)
    tree[:, width:] = np.where(rank < 0, _BLANK, rank << 8 | place)
    level = width
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2
    sym, after, before, tree = sym.ravel(), after.ravel(), before.ravel(), tree.ravel()
    row = np.arange(n)
    while True:
        least = tree[row * (2 * width) + 1]
        live = least != _BLANK
        row, least = row[live], least[live]
        if not len(row):
            return sym.reshape(n, width + 1)[:, :width]
        flat, top = row * (width + 1), row * (2 * width)
        i = least & 255
        j = after[flat + i]
        k = after[flat + j]
        p = before[flat + i]
        sym[flat + i] = pairs.merged[least >> 8]
        sym[flat + j] = -1
        after[flat + i] = k
        before[flat + k] = i
        rank = pairs.ranks(sym[flat + i], sym[flat + k])
        _put(tree, top, width, i, np.where(rank < 0, _BLANK, rank << 8 | i))
        _put(tree, top, width, j, _BLANK)
        some = p >= 0
        flat, top, p = flat[some], top[some], p[some]
        rank = pairs.ranks(sym[flat + p], sym[flat + i[some]])
        _put(tree, top, width, p, np.where(rank < 0, _BLANK, rank << 8 | p))


def _put(tree: np.ndarray, top: np.ndarray, width: int, leaf: np.ndarray, value) -> None:
    """Set one leaf of each tree and the nodes above it."""
    node = leaf + width
    tree[top + node] = value
    for _ in range(width.bit_length() - 1):
        value = np.minimum(value, tree[top + (node ^ 1)])
        node = node >> 1
        tree[top + node] = value


def letter_kinds() -> np.ndarray:
    """Kind of every code point, by the classes of ``PATTERN``."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))  # all but surrogates
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, letters in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for run in regex.finditer(letters, every):
            kinds[ord(run[0][0]):ord(run[0][-1]) + 1] = kind
    return kinds


def _starts(point: np.ndarray, kind: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Where matches of ``PATTERN`` start, one behind the other, in texts that begin where ``apart`` is set.

    A match is a run of one kind.  A space before another kind goes with that; of other runs of spaces the
    last one stands alone, unless the text ends there.  An apostrophe that starts a match takes its letters.
    """
    n, joined = len(point), ~apart[1:-1]  # letters 1 on that belong with the one before them
    start = np.ones(n, bool)
    space = kind == _SPACE
    start[1:] = (kind[1:] != kind[:-1]) & ~((point[:-1] == 0x20) & ~space[1:])
    start[1:-1] |= space[:-2] & space[1:-1] & ~space[2:] & joined[1:]
    start[1:] |= ~joined
    mark = np.flatnonzero((point == 0x27) & start)
    mark = mark[(mark + 1 < n) & ~apart[mark + 1]]
    one = mark[_SHORT[np.minimum(point[mark + 1], 127)]]
    more = mark[(mark + 2 < n) & ~apart[mark + 2]]
    two = np.array([i for i in more.tolist() if (int(point[i + 1]), int(point[i + 2])) in _LONG], np.int64)
    start[one + 1] = start[two + 1] = False
    after = np.concatenate([one + 2, two + 3])
    start[after[after < n]] = True
    return start


class Pairs:
    """Rank and result of merges, looked up for arrays of pairs."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in merges], np.int64)
        rank = np.array([r for r, _ in merges.values()], np.int32)
        self.merged = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.merged[rank] = [new for _, new in merges.values()]
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):  # each round places one key in each free slot that is asked for
            free = self.key[slot] == -1
            places, chosen = np.unique(np.where(free, slot, -1), return_index=True)
            chosen = chosen[places >= 0]
            self.key[slot[chosen]], self.rank[slot[chosen]] = keys[chosen], rank[chosen]
            left = np.ones(len(keys), bool)
            left[chosen] = False
            keys, rank, slot = keys[left], rank[left], (slot[left] + 1) % len(self.key)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge or a symbol is -1."""
        keys = a.astype(np.int64) << 32 | b  # negative with a blank: in no slot, or as the key of free ones, whose rank is -1
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.rank[slot], np.int32(-1))
        seek = np.flatnonzero((found != keys) & (found != -1))
        at = slot[seek]
        while len(seek):
            at = (at + 1) % len(self.key)
            found = self.key[at]
            hit = found == keys[seek]
            out[seek[hit]] = self.rank[at[hit]]
            go = ~hit & (found != -1)
            seek, at = seek[go], at[go]
        return out


class Vocabulary:
    """Merges, ids and bytes of a byte-level BPE file in the tokenizers JSON format."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        vocab = file["model"]["vocab"]
        self.merges = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        value = {c: b for b, c in enumerate(letters)}
        self.size = max(vocab.values()) + 1
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.size = max([self.size, *(i + 1 for i in added.values())])
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(value[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.kinds = letter_kinds()
        self.pairs = Pairs(self.merges)
        self.known = _Known(self)

    def ids(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """:meth:`ids` of several texts."""
        ids, ends = self.encoded(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each text's begin (and the last one's end)."""
        pieces, first = self._pieces(texts)
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        coded = pieces.dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.known.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        self.known.learn({distinct[i] for i in missing})
        for i in missing:
            found[i] = self.known[distinct[i]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), "<u4"), np.append(0, np.cumsum(size))[:-1]
        count = size[which]
        ends = np.append(0, np.cumsum(count))
        return flat[np.repeat(begin[which] - ends[:-1], count) + np.arange(ends[-1])], ends[first]

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of all texts in order, and the number of them before each text (and in all)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, buffer = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = (buffer if buffer is not None else pa.py_buffer(b""))[int(at[0]):int(at[-1])]
        at, whole = at - at[0], data.to_pybytes().decode()
        if not whole:
            return pa.array([], pa.large_string()), np.zeros(len(at), np.int64)
        point = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        place = np.append(0, np.cumsum(1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)))  # in bytes
        edge = np.searchsorted(place, at)  # where texts begin, in letters
        apart = np.zeros(len(point) + 1, bool)  # nothing matches across these places
        apart[edge] = True
        spans = []
        if self.cut is not None and any(t in whole for t in self.added):
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                spans += [(low + m.start(), low + m.end()) for m in self.cut.finditer(whole[low:high])]
            apart[[i for span in spans for i in span]] = True
        start = _starts(point, self.kinds[point], apart)
        for low, high in spans:
            start[low + 1:high] = False
        cuts = np.append(place[:-1][start], place[-1])
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data)
        return pieces, np.append(0, np.cumsum(start))[edge]

    def text(self, ids: bytes) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Known(dict):
    """Ids of pre-tokens by text.

    When full it starts afresh and keeps the full table as the older one; what is met again moves over,
    so common pre-tokens are never merged again and the two tables have a fixed bound.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.of = vocabulary
        self.first = np.array(vocabulary.first, np.int32)
        self.forget()

    def forget(self) -> None:
        self.older = dict(self)
        self.clear()
        self.update({t: i.to_bytes(4, "little") for t, i in self.of.added.items()})

    def learn(self, pieces: set[str]) -> None:
        """Merge those of ``pieces`` that are short and not known yet, all at once."""
        if len(self) > REMEMBERED:
            self.forget()
        missing = pieces.difference(self)
        again = missing.intersection(self.older)
        self.update((piece, self.older[piece]) for piece in again)
        new = [piece for piece in missing - again if len(piece) <= REMEMBERED_CHARS]
        raw = [piece.encode() for piece in new]
        size = np.array([len(r) for r in raw], np.int64)
        for low, high in zip((0, *_WIDTHS), _WIDTHS):
            chosen = np.flatnonzero((size > low) & (size <= high))
            if not len(chosen):
                continue
            have = size[chosen]
            symbols = np.full((len(chosen), high), -1, np.int32)
            symbols[np.arange(high) < have[:, None]] = self.first[np.frombuffer(b"".join(raw[c] for c in chosen), np.uint8)]
            out = merge_rows(symbols, high, self.of.pairs)
            kept = out >= 0
            ids, ends = out[kept].astype("<u4").tobytes(), [0, *(np.cumsum(kept.sum(1)) * 4).tolist()]
            self.update((new[c], ids[a:b]) for c, a, b in zip(chosen.tolist(), ends[:-1], ends[1:], strict=True))

    def __missing__(self, piece: str) -> bytes:
        symbols = [self.of.first[b] for b in piece.encode()]
        return np.array(merge(symbols, self.of.merges), "<u4").tobytes()


_loaded: dict[bytes, Vocabulary] = {}


def loaded(content: bytes) -> Vocabulary:
    """The vocabulary of a file's content, parsed once per worker."""
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def shared(df: DataFrame, path: str):
    """Broadcast the file at ``path``, which only the driver needs to see."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _encoded(batches: Iterator[pa.RecordBatch], content, digest: bool) -> Iterator[pa.RecordBatch]:
    vocabulary = loaded(content.value)
    for batch in batches:
        for low, high in slices(batch.column("text")):
            ids, ends = vocabulary.encoded(batch.column("text").slice(low, high - low))
            out = {"doc_id": batch.column("doc_id").slice(low, high - low), "n_tokens": pa.array(np.diff(ends), pa.int64())}
            if digest:
                found = [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                out["ids_sha256"] = pa.array([hashlib.sha256(own).hexdigest() for own in found], pa.string())
                out["decoded_sha256"] = pa.array(
                    [hashlib.sha256(vocabulary.text(own).encode()).hexdigest() for own in found], pa.string())
            else:
                out["ids"] = pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32))
            yield pa.record_batch(out)


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, n_tokens`` and ``ids`` of every whole text; ``path`` is a tokenizers JSON file.

    ``digest`` encodes, decodes again, and gives ``ids_sha256, decoded_sha256`` in place of the ids.
    """
    last = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return source.mapInArrow(partial(_encoded, content=shared(docs, path), digest=digest), f"doc_id long, n_tokens long, {last}")


def _decoded(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    vocabulary = loaded(content.value)
    for batch in batches:
        texts = [vocabulary.text(np.array(ids.as_py() or [], "<u4").tobytes()) for ids in batch.column("ids")]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, content=shared(encoded, path)), "doc_id long, text string")
