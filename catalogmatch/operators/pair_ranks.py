"""The rank of given pairs among all items, by counting the closer ones.

No list of neighbours is made and no rank is cut off: a pass over the items counts, for every given pair
of a query and an item, the items that are closer to the query (or as close, with a smaller id).  Tasks
emit one count per pair.  Few pairs are broadcast (rows and bytes are checked) and the items stream
past; many are cut into blocks that meet blocks of items in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.operators import knn
from catalogmatch.session import shared_dir, wide_tasks

_COUNTS = "query_id bigint, cd_insumo bigint, closer bigint"


class _Counter:
    """Running counts of the items closer than each pair's own."""

    def __init__(self, pairs: pa.Table):
        self.query_ids, self.item_ids = (pairs.column(c).to_numpy() for c in ("query_id", "cd_insumo"))
        _, first, self.query = np.unique(self.query_ids, return_index=True, return_inverse=True)
        vectors = pairs.column("query").combine_chunks()
        self.queries = knn._unit_rows(vectors.take(pa.array(first)))
        own = knn._unit_rows(pairs.column("item"), self.queries.shape[1])
        self.similarity = self._rounded(np.einsum("ij,ij->i", self.queries[self.query], own))
        self.closer = np.zeros(len(self.query), np.int64)

    @staticmethod
    def _rounded(products: np.ndarray) -> np.ndarray:
        return np.round(products, knn.DIGITS) + 0.0

    def add(self, ids: np.ndarray, items: np.ndarray, step: int = 512) -> None:
        for low in range(0, len(items), 4096):
            part, some = items[low:low + 4096], ids[low:low + 4096]
            sims = self._rounded(self.queries @ part.T)
            for at in range(0, len(self.query), step):
                rows = slice(at, at + step)
                other, own = sims[self.query[rows]], self.similarity[rows, None]
                self.closer[rows] += ((other > own) | ((other == own) & (some < self.item_ids[rows, None]))).sum(1)

    def table(self) -> pa.Table:
        return pa.table({"query_id": self.query_ids, "cd_insumo": self.item_ids, "closer": self.closer})


def _blocks(pairs: pa.Table, size: int = 1_024) -> list[_Counter]:
    ordered = pairs.sort_by("query_id")  # so a query's pairs share its products
    return [_Counter(ordered.slice(low, size)) for low in range(0, ordered.num_rows, size)]


def rank_pairs(pairs: DataFrame, queries: DataFrame, items: DataFrame, cell_items: int = knn.CELL_ITEMS, cell_pairs: int = knn.CELL_QUERIES) -> DataFrame:
    """``query_id, cd_insumo, knn_rank`` of every distinct pair whose query and item have a vector.

    The rank is the one ``knn_exact`` would give with ``k`` as large as it takes.
    """
    spark = items.sparkSession
    wanted, stored = knn._select(queries, items)
    given = pairs.select(F.col("query_id").cast("bigint"), F.col("cd_insumo").cast("bigint")).distinct()
    given = given.join(wanted.withColumnRenamed("vector", "query"), "query_id").join(stored.withColumnRenamed("vector", "item"), "cd_insumo")
    path = shared_dir(spark, "pairs")
    given.write.parquet(path)  # the vectors are found once, whatever follows
    given = spark.read.schema(given.schema).parquet(path)
    count = given.count()
    first = given.select((F.size("query") + F.size("item")).alias("numbers")).first()
    if first is None:
        return spark.createDataFrame([], "query_id bigint, cd_insumo bigint, knn_rank bigint")
    if count <= knn.QUERY_ROWS and count * 4 * first.numbers <= knn.QUERY_BYTES:
        shared = spark.sparkContext.broadcast(given.toArrow())

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counters = _blocks(shared.value)
            for batch in batches:
                vectors = knn._unit_rows(batch.column(1), counters[0].queries.shape[1])
                for counter in counters:
                    counter.add(batch.column(0).to_numpy(zero_copy_only=False), vectors)
            for counter in counters:
                yield from counter.table().to_batches()

        counts = stored.coalesce(wide_tasks(spark)).mapInArrow(stream, _COUNTS)
    else:
        item_blocks, pair_blocks = 1 + stored.count() // cell_items, 1 + count // cell_pairs
        every = {name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for name, n in (("ib", item_blocks), ("pb", pair_blocks))}
        left = given.withColumn("pb", F.pmod(F.xxhash64("query_id", "cd_insumo"), F.lit(pair_blocks)).cast("int")).withColumn("ib", every["ib"])
        right = stored.withColumn("ib", F.pmod(F.xxhash64("cd_insumo", "vector"), F.lit(item_blocks)).cast("int")).withColumn("pb", every["pb"])

        def cell(some_pairs: pa.Table, some_items: pa.Table) -> pa.Table:
            if not some_pairs.num_rows or not some_items.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "cd_insumo", "closer")})
            counters = _blocks(some_pairs)
            ids, vectors = some_items.column("cd_insumo").to_numpy(), knn._unit_rows(some_items.column("vector"), counters[0].queries.shape[1])
            for counter in counters:
                counter.add(ids, vectors)
            return pa.concat_tables(counter.table() for counter in counters)

        counts = left.groupBy("pb", "ib").cogroup(right.groupBy("pb", "ib")).applyInArrow(cell, _COUNTS)
    return counts.groupBy("query_id", "cd_insumo").agg((1 + F.sum("closer")).alias("knn_rank"))
