"""Best items per query where both sides carry the number of a cell: an equi-join of bounded pieces.

A cell may hold any share of the items or of the queries.  Items of a large cell are dealt into pieces
and its queries into blocks, by a hash of id and vector, and every piece meets every block of its own
cell; so no task holds more than a piece and a block, and no pair leaves it but the best k per query.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.operators import knn


def _parts(cells: DataFrame, rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """``rows`` with the part of its cell that each belongs to; ``cells`` has the number of parts as ``name``s."""
    dealt = rows.join(cells, "cell")
    own = F.pmod(F.xxhash64(key, "vector"), F.col(f"{name}s")).alias(name)
    return dealt.select("cell", F.col(key), "vector", own, "pieces", "blocks")


def cell_best(queries: DataFrame, items: DataFrame, k: int, cell_queries: int = knn.CELL_QUERIES, cell_items: int = knn.CELL_ITEMS) -> DataFrame:
    """``query_id, cd_insumo, similarity``: the best ``k`` per query and piece among the items of its cells.

    ``queries`` need ``cell, query_id, vector``; ``items`` need ``cell, cd_insumo, vector``.  A query or an
    item may be in several cells, so a pair may be found more than once.
    """
    sizes = items.groupBy("cell").agg(F.count("*").alias("n")).join(queries.groupBy("cell").agg(F.count("*").alias("q")), "cell")
    cells = sizes.select("cell", F.expr(f"1 + n div {cell_items}").alias("pieces"), F.expr(f"1 + q div {cell_queries}").alias("blocks"))
    left = _parts(cells, queries, "query_id", cell_queries, "block").withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
    right = _parts(cells, items, "cd_insumo", cell_items, "piece").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))

    def best(some_queries: pa.Table, some_items: pa.Table) -> pa.Table:
        if not some_queries.num_rows or not some_items.num_rows:
            return knn._RESULT.empty_table()
        rows = knn._unit_rows(some_queries.column("vector"))
        block = some_items.column("cd_insumo").to_numpy(), knn._unit_rows(some_items.column("vector"), rows.shape[1])
        return pa.concat_tables(knn._best_of(some_queries.column("query_id").to_numpy(), rows, k, [block]))

    at = ["cell", "piece", "block"]
    return (left.select(*at, "query_id", "vector").groupBy(at).cogroup(right.select(*at, "cd_insumo", "vector").groupBy(at))
            .applyInArrow(best, knn._RESULT_DDL))
