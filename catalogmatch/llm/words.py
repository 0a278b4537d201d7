"""Word and window hashes of an Arrow batch of texts, in NumPy.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  All operators that compare words or windows of
words share these functions, so equal words have equal 64-bit hashes in every task and every run.
A null text counts as empty.  Working memory is a few hundred bytes per word and per 64 KB of text,
whatever the length of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_BLOCK = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public SplitMix64 generator: a bijection of 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER = _powers(_BASE, _BLOCK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


@dataclass
class Words:
    """Words of a slice of texts: hash, byte range in ``data``, and the first word of each text."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Number of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = int(np.searchsorted(end, start[at] + _BLOCK, side="right"))
        if stop == at:  # one word longer than a block
            total, scale = 0, 1
            for p in range(int(start[at]), int(end[at]), _BLOCK):
                piece = data[p:min(p + _BLOCK, int(end[at]))]
                part = int((_LETTER[piece] * _POWER[:len(piece)]).sum(dtype=np.uint64))
                total = (total + part * scale) & (2**64 - 1)
                scale = scale * int(_POWER[len(piece)]) & (2**64 - 1)
            out[at] = total
            at += 1
            continue
        low = int(start[at])
        piece = data[low:int(end[stop - 1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LETTER[piece] * _POWER[:len(piece)], dtype=np.uint64, out=sums[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = (sums[e] - sums[s]) * _INVERSE[s]
        at = stop
    return mix(out ^ (end - start).astype(np.uint64))


def split(texts: pa.Array, fold: bool = False) -> Words:
    """Words of every text; ``fold`` lower-cases A-Z first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), empty, empty, np.zeros(0, np.uint64), np.zeros(1, np.int64))
    _, offsets, buffer = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    data, at = raw[at[0]:at[-1]], at - at[0]
    if fold:
        data = _FOLD[data]
    word = ~_SPACE[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    opens[inner] = word[inner]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    last = at[1:][at[1:] > 0] - 1
    closes[last] = word[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, at, start, end, _hashes(data, start, end), np.searchsorted(start, at))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, at least one text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    low = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield low, i
            low, held = i, 0
        held += int(n)
    if low < len(sizes):
        yield low, len(sizes)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` hashes; run ``i`` starts at ``i``.  Runs may cross text borders."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size + seed, np.uint64)
    for k in range(size):
        out = out * _STEP + hashes[k:k + n]
    return mix(out)


def inside(words: Words, size: int) -> np.ndarray:
    """Start positions of the windows of ``size`` words that lie within one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], words.counts)[:n] - size
    at = np.arange(n)
    return at[at <= last]


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:len(out) - (width - have)], out[width - have:])
    return out[:n]
