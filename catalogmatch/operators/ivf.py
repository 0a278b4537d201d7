"""Exact nearest neighbours over a clustered item table, reading only clusters that can matter.

Items are stored by cluster with each cluster's size and radius.  By the triangle inequality an item
of a cluster cannot be closer to a query than the distance to the centre minus the radius, so after
a first look into the nearest clusters every cluster whose bound lies beyond the k-th item found is
skipped.  What remains is searched completely: the rows are those of ``knn_exact``.

A cluster may hold any share of the items.  It is never gathered in one place: its files are streamed
past the broadcast queries like any scan, or dealt into pieces that meet blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.operators import knn
from catalogmatch.operators.cells import cell_best
from catalogmatch.session import shared_dir, wide_tasks

ITEMS_PER_CLUSTER = 2_000  # clusters grow in number with the items, up to MOST_CLUSTERS
MOST_CLUSTERS = 4_096
LOOKS = 2_000_000            # pairs of query and cluster that may pass through the driver


@dataclass(frozen=True)
class ClusteredItems:
    """Where the clustered items lie, and what is known about each cluster."""

    path: str
    centres: np.ndarray   # one row per cluster
    sizes: np.ndarray     # rows per cluster; the last entry counts items without length
    radii: np.ndarray


def cluster_items(items: DataFrame, clusters: int | None = None, path: str | None = None, seed: int = 7) -> ClusteredItems:
    """Store ``cd_insumo, vector`` by cluster; ``path`` defaults to the shared folder.

    The centres are fitted on all items by Spark's k-means; their number follows from the row count
    unless it is given.
    """
    spark = items.sparkSession
    path = path or shared_dir(spark, "clusters")
    stored = items.select(
        F.col("cd_insumo").cast("bigint"), F.col("vector").cast("array<float>").alias("vector"))
    if clusters is None:
        clusters = max(16, min(MOST_CLUSTERS, stored.count() // ITEMS_PER_CLUSTER))
    model = KMeans(k=clusters, seed=seed, maxIter=10).fit(stored.select(array_to_vector("vector").alias("features")))
    centres = np.array(model.clusterCenters())
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            rows = knn._unit_rows(batch.column(1), middle.shape[1])
            squares = (rows ** 2).sum(1)[:, None] + (middle ** 2).sum(1)[None, :] - 2 * rows @ middle.T
            nearest = squares.argmin(1) if len(rows) else np.empty(0, np.int64)
            distance = np.linalg.norm(rows - middle[nearest], axis=1)
            lengthless = ~rows.any(axis=1)  # similar to nothing: a cluster that is always read
            nearest = np.where(lengthless, len(middle), nearest)
            distance = np.where(lengthless, np.inf, distance)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nearest.astype(np.int32)), pa.array(distance)],
                names=["cd_insumo", "vector", "cluster", "distance"])

    placed = stored.mapInArrow(assign, "cd_insumo bigint, vector array<float>, cluster int, distance double")
    # rebalancing brings a cluster's rows into few files and splits a cluster that is too large
    placed.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(path)
    known = spark.read.parquet(path).groupBy("cluster").agg(
        F.count("*").alias("n"), F.max("distance").alias("radius")).toPandas()
    sizes, radii = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres) + 1)
    sizes[known.cluster], radii[known.cluster] = known.n, known.radius
    return ClusteredItems(path, centres, sizes, radii)


def _to_centres(rows: np.ndarray, items: ClusteredItems) -> np.ndarray:
    """Distances of unit rows to all centres; items without length count as near."""
    squares = (rows ** 2).sum(1)[:, None] + (items.centres ** 2).sum(1)[None, :] - 2 * rows @ items.centres.T
    return np.hstack([np.sqrt(np.maximum(squares, 0)), np.zeros((len(rows), 1))])


def _first(distances: np.ndarray, items: ClusteredItems, k: int) -> np.ndarray:
    """The nearest clusters that hold ``k`` items together: rows x clusters."""
    order = np.argsort(distances, axis=1, kind="stable")
    before = np.cumsum(items.sizes[order], axis=1) - items.sizes[order]
    out = np.zeros(distances.shape, bool)
    np.put_along_axis(out, order, before < k, axis=1)
    return out & (items.sizes > 0)


def _looks(queries: DataFrame, items: ClusteredItems, k: int, again: bool, vectors: bool) -> DataFrame:
    """``query_id, cell`` (and ``vector``): the clusters of the first look, or of the second.

    ``queries`` have ``query_id, vector`` and for the second look ``reach``, the distance within which items
    matter (null: any).  Distances are computed in tasks, a stretch of queries at a time.
    """
    shared = queries.sparkSession.sparkContext.broadcast(items)  # at most MOST_CLUSTERS centres

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                distances = _to_centres(knn._unit_rows(part.column("vector"), known.centres.shape[1]), known)
                wanted = _first(distances, known, k)
                if again:
                    reach = part.column("reach").to_numpy(zero_copy_only=False)
                    reach = np.where(np.isnan(reach), np.inf, reach)
                    wanted = (distances - known.radii - 1e-6 <= reach[:, None]) & ~wanted & (known.sizes > 0)
                row, cluster = np.nonzero(wanted)
                out = {"query_id": part.column("query_id").take(pa.array(row)), "cell": pa.array(cluster.astype(np.int64))}
                if vectors:
                    out["vector"] = part.column("vector").take(pa.array(row))
                yield pa.record_batch(out)

    ddl = "query_id bigint, cell bigint" + (", vector array<float>" if vectors else "")
    return queries.mapInArrow(look, ddl)


def _stream(items: ClusteredItems, query_ids: np.ndarray, rows: np.ndarray, looks: pa.Table, k: int, spark) -> DataFrame:
    """Best k per query and task: the clusters' files are streamed past the broadcast queries.

    ``looks`` names the queries of each cluster.
    """
    position = np.argsort(query_ids, kind="stable")
    at = position[np.searchsorted(query_ids[position], looks.column("query_id").to_numpy())]
    cells = looks.column("cell").to_numpy()
    order = np.lexsort((at, cells))
    shared = spark.sparkContext.broadcast((query_ids, rows, at[order], cells[order]))
    read = [int(c) for c in np.unique(cells)]
    table = spark.read.parquet(items.path).where(F.col("cluster").isin(read)).select("cd_insumo", "vector", "cluster")

    def local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, rows, at, cells = shared.value
        size = 1024
        blocks = [knn._Best(query_ids[r:r + size], rows[r:r + size], k) for r in range(0, len(rows), size)]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = knn._unit_rows(batch.column(1), rows.shape[1])
            clusters = batch.column(2).to_numpy(zero_copy_only=False)
            for cluster in np.unique(clusters):
                asking = at[np.searchsorted(cells, cluster):np.searchsorted(cells, cluster, side="right")]
                members = np.flatnonzero(clusters == cluster)
                for c in range(0, len(members), 4096):
                    part = members[c:c + 4096]
                    exact, coarse = vectors[part], vectors[part].astype(np.float32)
                    for b in np.unique(asking // size):
                        blocks[b].add(ids[part], exact, coarse, asking[asking // size == b] - b * size)
        for block in blocks:
            yield from block.table().to_batches()

    return table.coalesce(wide_tasks(spark)).mapInArrow(local_best, knn._RESULT_DDL)


def _join(items: ClusteredItems, looks: DataFrame, k: int) -> DataFrame:
    """Best k per query and piece of a cluster: queries and items meet by cluster number."""
    spark = looks.sparkSession
    path = shared_dir(spark, "looks")
    looks.write.parquet(path)
    stored = spark.read.schema(looks.schema).parquet(path)
    read = [row.cell for row in stored.select("cell").distinct().collect()]  # at most MOST_CLUSTERS + 1
    table = spark.read.parquet(items.path).where(F.col("cluster").isin(read)).select(
        F.col("cluster").cast("bigint").alias("cell"), "cd_insumo", "vector")
    return cell_best(stored, table, k)


def knn_ivf(queries: DataFrame, items: ClusteredItems, k: int, broadcast: bool | None = None) -> DataFrame:
    """The ``k`` closest items per query, the same rows as ``knn_exact``.

    Which clusters a query looks into is found in tasks.  Where the queries and the pairs of query and
    cluster are few enough (both counted) the items stream past the broadcast queries; else both meet
    by an equi-join on the cluster, whose pieces and blocks are bounded.  Either way the items are read
    once for the first look and once for the second, however many queries there are.  ``broadcast`` fixes
    the way.
    """
    spark = queries.sparkSession
    path = shared_dir(spark, "queries")
    queries.select(F.col("query_id").cast("bigint"), F.col("vector").cast("array<float>").alias("vector")).write.parquet(path)
    wanted = spark.read.schema("query_id bigint, vector array<float>").parquet(path)
    few = knn.small_enough(wanted) if broadcast is None else broadcast
    sample = wanted.toArrow() if few else None
    if few and not sample.num_rows:
        return knn._merge(spark.createDataFrame([], knn._RESULT_DDL), k)

    def search(rows: DataFrame, again: bool) -> DataFrame:
        if few:
            looks = _looks(rows, items, k, again, vectors=False)
            if broadcast or looks.count() <= LOOKS:
                found = looks.toArrow()
                if not found.num_rows:
                    return spark.createDataFrame([], knn._RESULT_DDL)
                return _stream(items, sample.column("query_id").to_numpy(), knn._unit_rows(sample.column("vector")), found, k, spark)
        return _join(items, _looks(rows, items, k, again, vectors=True), k)

    # the first look is written down, so the bound and the result read it instead of repeating it
    path = shared_dir(spark, "first-look")
    knn._merge(search(wanted, False), k, clip=False).write.parquet(path)
    found = spark.read.schema("query_id bigint, cd_insumo bigint, similarity double, knn_rank int").parquet(path)
    reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity") + 4 * 10.0 ** -knn.DIGITS))
    kth = found.where(F.col("knn_rank") == k).select("query_id", reach.alias("reach"))
    rest = search(wanted.join(kth, "query_id", "left"), True)
    return knn._merge(found.drop("knn_rank").unionByName(rest), k)
