"""Exact nearest neighbours in Spark expressions alone, over items stored by cluster.

Queries are joined with the items of their cells by cluster number; similarities are expressions, and
the best k per query are taken twice, in every task before the shuffle and after it.  Which cells a query
needs follows from the same bounds as in ``ivf``: the nearest that hold k items give a similarity that the
k-th closest reaches, and only cells and pairs that may reach it are looked at.  No Python runs, and no pair
is made outside the cells that count.

Functions over arrays are interpreted, some 9 microseconds a pair of 64 numbers.  Where pairs are many, up to
``WIDE`` numbers are columns instead, whose products Spark compiles into the join; it does so for few columns unless told
otherwise, so the pairs are made in a session of their own and the caller's settings stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogmatch.operators import knn
from catalogmatch.operators.ivf import ClusteredItems
from catalogmatch.session import shared_dir, wide_tasks

WIDE = 96               # numbers of a vector that may be columns: beyond that the compiled join grows too long
COMPILED = 20_000_000   # pairs of query and item: below that compiling takes longer than the pairs
SLOTS = 2               # for each of k: groups of items whose best give a bound on the k-th closest
SLACK = 1e-6            # two similarities that round alike differ by no more


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _unit(vector: Column) -> Column:
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(_sum(F.transform(doubles, lambda x: x * x)))
    return F.transform(doubles, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def _checked(queries: DataFrame, dim: int) -> DataFrame:
    sound = F.coalesce((F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    vector = F.when(sound, F.col("vector").cast("array<float>")).otherwise(
        F.raise_error(F.lit(f"queries need vectors of {dim} finite numbers")).cast("array<float>"))
    return queries.select(F.col("query_id").cast("bigint").alias("query_id"), vector.alias("vector"))


def _columns(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Numbers of a vector as columns ``<vector>0``, ``<vector>1`` ...; none is null, and Spark is told so."""
    return rows.select(*[c for c in rows.columns if c != vector], *[F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)).alias(f"{vector}{i}") for i in range(dim)])


def _added(terms: list[Column]) -> Column:
    """Neighbours are added first, so that no sum waits for all before it."""
    while len(terms) > 1:
        terms = [sum(terms[i + 1:i + 2], terms[i]) for i in range(0, len(terms), 2)]
    return terms[0]


def _pairs(queries: DataFrame, near: DataFrame, items: DataFrame, clusters: int, dim: int | None) -> tuple[DataFrame, Column]:
    """Every query beside the items of the clusters that ``near`` names, and their product.

    Clusters are few and small in bytes, but every pair of them costs: the queries of a cluster are dealt into
    shares, its items go to every share, and the number of tasks is given; two shares seldom meet in one.
    """
    shares = max(1, 4 * wide_tasks(near.sparkSession) // max(1, clusters))
    tasks = 2 * shares * (clusters + 1)
    if dim is None:
        product = _sum(F.zip_with("unit", "own", lambda x, y: x * y))
    else:
        queries, items = _columns(queries, "unit", dim), _columns(items, "own", dim)
        product = _added([F.col(f"unit{i}") * F.col(f"own{i}") for i in range(dim)])
    asking = near.join(queries, "query_id").withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    offered = items.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    at = ["cluster", "share"]
    return asking.repartition(tasks, *at).join(offered.repartition(tasks, *at).hint("merge"), at), product


def _best(queries: DataFrame, near: DataFrame, items: DataFrame, clusters: int, dim: int | None = None) -> DataFrame:
    """``query_id, cd_insumo, similarity`` of the items of the clusters that ``near`` names.

    Where ``near`` has a ``floor`` of each query, only pairs whose product may round to it are given.
    """
    pairs, product = _pairs(queries, near, items, clusters, dim)
    if "floor" in near.columns:
        pairs = pairs.where(product >= F.col("floor") - SLACK)
    return pairs.select("query_id", "cd_insumo", (F.round(product, knn.DIGITS) + F.lit(0.0)).alias("similarity"))


def _floors(queries: DataFrame, near: DataFrame, items: DataFrame, clusters: int, k: int, dim: int | None) -> DataFrame:
    """``query_id, floor``: what the product with the k-th closest item is at least; null where fewer are seen.

    Items of the clusters are dealt into slots and only the best of each is kept: of the slots' best the k-th
    is no closer than the k-th of all, and nothing is sorted but a few numbers of each query.
    """
    pairs, product = _pairs(queries, near, items, clusters, dim)
    slot = F.pmod(F.xxhash64("cd_insumo"), F.lit(SLOTS * k)).alias("slot")
    slots = pairs.groupBy("query_id", slot).agg(F.max(product).alias("best"))
    ordered = F.sort_array(F.collect_list("best"), asc=False)
    return slots.groupBy("query_id").agg(F.get(ordered, F.lit(k - 1)).alias("floor"))


def _wide_session(spark: SparkSession, dim: int) -> SparkSession:
    """A session of the same application and settings in which joins of many columns are compiled."""
    wide = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            wide.conf.set(key, value)
    wide.conf.set("spark.sql.codegen.maxFields", str(100 + 2 * dim))
    return wide


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("cd_insumo"))
    return found.withColumn("knn_rank", F.row_number().over(order)).where(F.col("knn_rank") <= k)


def knn_sql(queries: DataFrame, items: ClusteredItems, k: int) -> DataFrame:
    """The ``k`` closest items per query, the same rows as ``knn_exact``."""
    spark = queries.sparkSession
    count, dim = items.centres.shape
    centres = [[float(x) for x in row] for row in items.centres] + [None]  # the last holds items without length
    cells = spark.createDataFrame(  # at most ivf.MOST_CLUSTERS + 1 rows
        [(c, centres[c], int(items.sizes[c]), float(items.radii[c])) for c in range(count + 1) if items.sizes[c]],
        "cluster int, centre array<double>, n bigint, radius double")
    path = shared_dir(spark, "sql-queries")
    _checked(queries, dim).select("query_id", _unit(F.col("vector")).alias("unit")).write.parquet(path)
    wanted = spark.read.schema("query_id bigint, unit array<double>").parquet(path)
    every = wanted.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(count)))).join(F.broadcast(cells), "cluster")
    distance = F.sqrt(_sum(F.zip_with("unit", "centre", lambda x, y: (x - y) * (x - y))))
    every = every.select("query_id", "cluster", "n", "radius", F.coalesce(F.when(F.col("centre").isNotNull(), distance), F.lit(0.0)).alias("distance"))
    nearest = Window.partitionBy("query_id").orderBy("distance", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    near = every.withColumn("first", F.coalesce(F.sum("n").over(nearest), F.lit(0)) < k)
    cells_path = shared_dir(spark, "sql-cells")
    near.select("query_id", "cluster", "first", (F.col("distance") - F.col("radius") - 1e-6).alias("bound")).write.parquet(cells_path)
    columns = dim if dim <= WIDE and wanted.count() * int(items.sizes.sum()) >= COMPILED else None
    wide = _wide_session(spark, dim) if columns else spark
    wanted = wide.read.schema("query_id bigint, unit array<double>").parquet(path)
    near = wide.read.schema("query_id bigint, cluster int, first boolean, bound double").parquet(cells_path)
    # an item's vector is scaled once, before it meets its queries
    stored = wide.read.parquet(items.path).select("cd_insumo", _unit(F.col("vector")).alias("own"), "cluster")
    path = shared_dir(spark, "sql-floors")
    _floors(wanted, near.where("first").select("query_id", "cluster"), stored, count, k, columns).write.parquet(path)
    floors = wide.read.schema("query_id bigint, floor double").parquet(path)
    reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("floor") + 4 * 10.0 ** -knn.DIGITS))
    open_ = near.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") <= reach)).select(
        "query_id", "cluster", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    best = _ranked(_best(wanted, open_, stored, count, columns), k)
    if columns:  # made where its join is compiled; the caller's session reads what is left
        path = shared_dir(spark, "sql-best")
        best.write.parquet(path)
        best = spark.read.schema("query_id bigint, cd_insumo bigint, similarity double, knn_rank int").parquet(path)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")).alias("score_sbert")
    return best.select("query_id", "cd_insumo", score, "knn_rank")
