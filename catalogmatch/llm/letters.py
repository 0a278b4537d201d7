"""Byte tables applied to an Arrow batch of texts before its words are split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def table(blank: bytes, ends: bytes = b"") -> np.ndarray:
    """A byte table that lower-cases A-Z, turns ``blank`` into a space and ``ends`` into a line feed."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[np.frombuffer(blank, np.uint8)] = 0x20
    out[np.frombuffer(ends, np.uint8)] = 0x0A
    return out


def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, buffer = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def translate(texts: pa.Array, by: np.ndarray) -> pa.Array:
    """``texts`` with every byte looked up in ``by``, which maps ASCII to ASCII and leaves other bytes alone."""
    data, at = whole(texts)
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(by[data]))
