"""Approximate nearest neighbours by random projections, several tables and several probes.

The signs of a vector's products with random planes are its bucket in a table.  Close vectors share a
bucket in some table, or stand on the other side of planes that the query lies close to; so a query
looks into its own bucket and those next to it, in the order of the squared distances to the planes
between (query-directed probing).  Items and probes meet by an equi-join on table and bucket; a bucket
may hold any share of the items and is dealt into pieces like every cell (``cells``).  Within the
buckets looked into all items are compared exactly, none are dropped: what an approximate search may miss
are items in buckets it does not look into.  ``knn_exact`` is the exact way.

How many probes a wanted recall takes is measured by ``probes_for`` on ``SAMPLE`` queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.operators import knn
from catalogmatch.operators.cells import cell_best

ITEMS_PER_BUCKET = 1_000
MOST_BITS = 24
NEAR_PLANES = 10   # planes nearest to a query whose other sides are looked into
SAMPLE = 200       # queries that probes_for measures with


def planes(dim: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    """``tables * bits`` random directions, given to three digits so that SQL can repeat them."""
    return np.round(np.random.default_rng(seed).standard_normal((tables * bits, dim)), 3)


def bits_for(items: int) -> int:
    """Planes per table for buckets of about ``ITEMS_PER_BUCKET``."""
    return int(np.clip(np.ceil(np.log2(max(items, 1) / ITEMS_PER_BUCKET)), 2, MOST_BITS))


def _sides(rows: np.ndarray, normals: np.ndarray, tables: int) -> np.ndarray:
    """Products with the planes: rows, tables, bits."""
    return (rows @ normals.T).reshape(len(rows), tables, -1)


def _buckets(sides: np.ndarray) -> np.ndarray:
    return ((sides >= 0).astype(np.int64) << np.arange(sides.shape[2])).sum(2)


def _probes(sides: np.ndarray, probes: int) -> np.ndarray:
    """Buckets to look into, nearest first: rows, tables, probes."""
    bits = sides.shape[2]
    near = min(bits, NEAR_PLANES)
    squares = sides ** 2
    planes_ = np.argsort(squares, axis=2, kind="stable")[:, :, :near]
    subsets = (np.arange(1 << near)[:, None] >> np.arange(near)) & 1
    cost = np.take_along_axis(squares, planes_, 2) @ subsets.T.astype(float)
    flips = (np.int64(1) << planes_) @ subsets.T
    order = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
    return _buckets(sides)[:, :, None] ^ np.take_along_axis(flips, order, 2)


def _cells(tables: int, buckets: np.ndarray) -> np.ndarray:
    at = np.arange(tables, dtype=np.int64) << 32
    return buckets + at.reshape((1, tables) + (1,) * (buckets.ndim - 2))


def _placed(rows: DataFrame, key: str, normals: np.ndarray, tables: int, probes: int | None) -> DataFrame:
    """One row for each vector and bucket: its own in every table, or those that ``probes`` name."""
    shared = rows.sparkSession.sparkContext.broadcast(normals)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                sides = _sides(knn._unit_rows(part.column(1), shared.value.shape[1]), shared.value, tables)
                cells = _cells(tables, _buckets(sides) if probes is None else _probes(sides, probes)).reshape(len(sides), -1)
                again = pa.array(np.repeat(np.arange(len(sides)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel()), part.column(0).take(again), part.column(1).take(again)], names=["cell", key, "vector"])

    return rows.mapInArrow(place, f"cell bigint, {key} bigint, vector array<float>")


def _dimension(queries: DataFrame, items: DataFrame) -> int:
    first = items.select(F.size("vector").alias("dim")).first() or queries.select(F.size("vector").alias("dim")).first()
    return max(0, first.dim or 0) if first else 0


def knn_lsh(queries: DataFrame, items: DataFrame, k: int, tables: int = 8, bits: int | None = None, probes: int = 16, seed: int = 7) -> DataFrame:
    """Up to ``k`` items per query like ``knn_exact``, from the buckets looked into.

    ``bits`` follows from the number of items unless it is given.  A query with fewer than ``k`` items in its
    buckets gets fewer rows.  Similarities and their order are those of ``knn_exact``.
    """
    wanted, stored = knn._select(queries, items)
    bits = bits or bits_for(stored.count())
    normals = planes(_dimension(wanted, stored), tables, bits, seed)
    found = cell_best(_placed(wanted, "query_id", normals, tables, probes), _placed(stored, "cd_insumo", normals, tables, None), k)
    return knn._merge(found.distinct(), k)


def probes_for(queries: DataFrame, items: DataFrame, k: int, recall: float = 0.95, tables: int = 8, bits: int | None = None, seed: int = 7) -> int:
    """The fewest probes that find the share ``recall`` of the true neighbours of ``SAMPLE`` queries.

    The sample is those with the least hash of their id; their neighbours come from ``knn_exact``.
    """
    wanted, stored = knn._select(queries, items)
    bits = bits or bits_for(stored.count())
    sample = wanted.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE)
    true = knn.knn_exact(sample, stored, k).select("query_id", "cd_insumo")
    pairs = true.join(F.broadcast(sample), "query_id").join(stored.withColumnRenamed("vector", "item"), "cd_insumo").select("vector", "item").toArrow()
    if not pairs.num_rows:
        return 1
    normals = planes(len(pairs.column("vector")[0]), tables, bits, seed)
    own = _sides(knn._unit_rows(pairs.column("vector")), normals, tables)
    other = _buckets(_sides(knn._unit_rows(pairs.column("item")), normals, tables))
    most = 1 << min(bits, NEAR_PLANES)
    hit = _probes(own, most) == other[:, :, None]
    first = np.where(hit.any(2), hit.argmax(2) + 1, most + 1).min(1)
    return int(min(most, np.sort(first)[int(np.ceil(recall * len(first))) - 1]))
