"""Token ids packed into rows of one length by best-fit decreasing.

Texts are encoded (``catalogmatch.llm.bpe``), cut into pieces of at most ``LENGTH`` ids, and the
pieces of a stretch of documents are packed: longest first, each into the row that it fills best.
The row is found in a segment tree over the room left in rows, so a piece costs logarithmic time.
A stretch is at most ``STRETCH`` ids and ends with the partition, which bounds the memory of a task
and needs no shuffle; only a stretch's last rows stay unfilled.

Each packed row holds ids and padding as a row of an id matrix (little-endian unsigned 32-bit), the
cumulative lengths of its segments from 0 on, the position of every id in its segment (starting
again at 0), and which piece of which document each segment is, so documents can be put together
again.

Defined results: a null or empty text has no ids and is in no row; documents may share an id or have
none, their segments then carry the same or a null id; nothing is dropped or cut off; an empty table gives no
rows; other columns, whatever their names, are ignored; a text of any length is split into pieces.  Which
documents share a row follows from the partitions of the table: another cut of its files packs other
rows of the same pieces, and many small partitions leave more rows part-filled (coalesce them first).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm import bpe
from catalogmatch.llm.words import slices

LENGTH = 2048
STRETCH = 4_000_000
PAD = 50256

SCHEMA = ("n_segments long, n_ids long, ids binary, cu_seqlens array<int>, position_ids binary, "
          "segments array<struct<doc_id:long,piece:int,n_ids:int>>")


class Rooms:
    """Rows by room left, under a segment tree that finds the least room of at least a size."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]
        self.some = bytearray(2 * self.width)

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = self.width + room
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Row with the least room that is enough, and its room; None if there is none."""
        node = self.width + size
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[node] = 0
            node >>= 1
            while node and not self.some[2 * node] and not self.some[2 * node + 1]:
                self.some[node] = 0
                node >>= 1
        return row, room


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Pieces of each row; sizes are from 1 to ``length``."""
    rooms, rows = Rooms(length), []
    for piece in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[piece])
        found = rooms.take(size)
        if found is None:
            found = len(rows), length
            rows.append([])
        row, room = found
        rows[row].append(piece)
        if room > size:
            rooms.put(row, room - size)
    return rows


def _rows_of(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix of 32-bit numbers as binary values."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * 4 * matrix.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix, "<u4"))])


def _packed(pieces: list[tuple[int | None, int, bytes]], length: int, pad: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(ids) // 4 for _, _, ids in pieces])
    rows = best_fit_decreasing(sizes, length)
    step = max(1, min(512, (1 << 28) // length))  # rows of a batch: offsets stay far below 2 GB
    for low in range(0, len(rows), step):
        some = rows[low:low + step]
        count = np.array([len(row) for row in some])
        order = [p for row in some for p in row]
        size = sizes[order]
        row = np.repeat(np.arange(len(some)), count)
        first = np.append(0, np.cumsum(count))  # the first piece of each row
        ends = np.append(0, np.cumsum(size))
        start = ends[:-1] - ends[first[:-1]][row]  # of each piece within its row
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        used = ends[first[1:]] - ends[first[:-1]]
        filled = np.arange(length) < used[:, None]  # segments lie back to back from the start of their row
        ids, places = np.full((len(some), length), pad, "<u4"), np.zeros((len(some), length), "<u4")
        ids[filled] = np.frombuffer(b"".join(pieces[p][2] for p in order), "<u4")
        places[filled] = place
        lengths = np.zeros(len(order) + len(some), np.int32)  # a leading 0 for each row, then the end of each piece
        lengths[np.arange(len(order)) + row + 1] = start + size
        segments = pa.StructArray.from_arrays(
            [pa.array([pieces[p][0] for p in order], pa.int64()), pa.array([pieces[p][1] for p in order], pa.int32()), pa.array(size.astype(np.int32))], ["doc_id", "piece", "n_ids"])
        yield pa.record_batch({
            "n_segments": pa.array(count.astype(np.int64)), "n_ids": pa.array(used.astype(np.int64)), "ids": _rows_of(ids),
            "cu_seqlens": pa.ListArray.from_arrays((first + np.arange(len(first))).astype(np.int32), pa.array(lengths)),
            "position_ids": _rows_of(places), "segments": pa.ListArray.from_arrays(first.astype(np.int32), segments)})


def _packing(batches: Iterator[pa.RecordBatch], content, length: int, pad: int, stretch: int) -> Iterator[pa.RecordBatch]:
    vocabulary = bpe.loaded(content.value)
    pieces: list[tuple[int | None, int, bytes]] = []
    held = 0
    for batch in batches:
        for low, high in slices(batch.column("text")):
            all_ids, ends = vocabulary.encoded(batch.column("text").slice(low, high - low))
            edges = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            for doc_id, (begin, end) in zip(batch.column("doc_id").slice(low, high - low).to_pylist(), edges, strict=True):
                ids = all_ids[begin:end].tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    pieces.append((doc_id, k, ids[at:at + 4 * length]))
                    held += len(pieces[-1][2]) // 4
                    if held >= stretch:
                        yield from _packed(pieces, length, pad)
                        pieces, held = [], 0
    if pieces:
        yield from _packed(pieces, length, pad)


def pack(docs: DataFrame, path: str, length: int = LENGTH, pad: int = PAD, stretch: int = STRETCH) -> DataFrame:
    """Packed rows of ``SCHEMA``: every id of every document once, in rows of ``length`` ids."""
    if length < 1:
        raise ValueError("rows need a length of 1 at least")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(partial(_packing, content=bpe.shared(docs, path), length=length, pad=pad, stretch=stretch), SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; the binary columns are the id and position matrices, row by row."""
    packed.write.parquet(path)
