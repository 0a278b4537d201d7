"""Write catalog, vector and feedback stores.

Appends that must not repeat rows anti-join the target on its key first, so a job that was lost
half-way can simply run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogmatch import schemas
from catalogmatch.session import shared_dir
from catalogmatch.sources import versions


KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def create_bucketed(spark: SparkSession, table: str, schema: StructType, key: str, buckets: int) -> None:
    """Create a table whose rows lie in ``buckets`` sorted buckets of ``key``, where it does not exist yet."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS")


def _buckets(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """The columns a table is bucketed by, and the number of buckets."""
    if not spark.catalog.tableExists(table):
        return [], 0
    keys = [c.name for c in spark.catalog.listColumns(table) if c.isBucket]
    known = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").collect() if keys else []
    return keys, int(known[0].data_type) if known else 0


def sink_append(df: DataFrame, target: str) -> None:
    """Append rows to a table or parquet path; an empty input adds no rows.

    Rows for a bucketed table are brought together by bucket first, so an append adds a file per bucket.
    """
    if "/" in target:
        df.write.mode("append").parquet(target)
        return
    keys, buckets = _buckets(df.sparkSession, target)
    if buckets:
        df.select(*df.sparkSession.table(target).columns).repartition(buckets, *keys).write.insertInto(target)
    else:
        df.write.mode("append").saveAsTable(target)


def sink_replace_small(df: DataFrame, target: str) -> None:
    """Replace the content of a small table such as the unit map.

    The new content is written aside and then published, so readers have the old one until the new one is
    whole, and a job that is lost changes nothing.  Below a path every content is a folder
    ``version=n``; it counts once Spark has marked it as complete, and ``read_small`` takes the last
    one that does.  The one before stays for readers under way, older ones go.  A table is pointed
    to the new folder.
    """
    rows = df.select("cd_medida", "medida")
    spark = df.sparkSession
    if "/" not in target:
        if not spark.catalog.tableExists(target):
            spark.createDataFrame([], rows.schema).write.saveAsTable(target)
        path = f"{versions.table_folder(spark, target)}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        spark.sql(f"ALTER TABLE {target} SET LOCATION '{path}'")
        spark.catalog.refreshTable(target)
        return
    known = versions.every(spark, target)
    rows.write.mode("overwrite").parquet(versions.folder(target, max(known, default=0) + 1))
    versions.drop(spark, target, versions.complete(spark, target)[:-2])


def split_bad_vectors(items: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Items whose vector has ``dim`` finite numbers, and those whose vector has not (or is missing)."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # false for NaN too
    good = F.coalesce((F.size("vector") == dim) & finite, F.lit(False))
    return items.where(good), items.where(~good)


def stamp_vectors(items: DataFrame, model_name: str, dim: int) -> DataFrame:
    """Vector rows with model, dimension and creation time."""
    return items.select(
        "cd_insumo",
        F.col("vector").cast(schemas.VECTOR).alias("vector"),
        F.lit(model_name).alias("model_name"),
        F.lit(dim).alias("embedding_dim"),
        F.current_timestamp().alias("created_at"),
    )


def sink_vectors_checked(items: DataFrame, target: str, model_name: str, dim: int) -> int:
    """Append vectors after checking their length; returns the number of rows written.

    The rows are staged in the shared folder first, so an expensive encoder runs once.  When any
    vector is wrong nothing reaches the target; the error counts them and names up to five ids.
    """
    spark = items.sparkSession
    stage = shared_dir(spark, "vectors")
    stamp_vectors(items, model_name, dim).write.parquet(stage)
    staged = spark.read.schema(schemas.ITEM_VECTORS).parquet(stage)
    _, bad = split_bad_vectors(staged.select("cd_insumo", "vector"), dim)
    count = bad.count()
    if count:
        named = [row.cd_insumo for row in bad.select("cd_insumo").orderBy("cd_insumo").limit(5).collect()]
        raise ValueError(f"{count} vectors do not have {dim} finite numbers; ids (up to 5): {named}")
    sink_append(staged, target)
    return staged.count()


JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _unseen(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    return rows if ids is None else rows.join(ids.select("feedback_id"), "feedback_id", "left_anti").select(*rows.columns)


def _other_batches(spark: SparkSession, path: str, batch: str, kind: str) -> DataFrame | None:
    """Ids in the folder of another batch; None where there is none."""
    if not any(name.startswith("batch=") and name != f"batch={batch}" for name in versions.children(spark, path)):
        return None
    return spark.read.format(kind).schema("feedback_id string, batch string").load(path).where(F.col("batch") != batch)


def sink_feedback(nested: DataFrame, target: str, jsonl: str | None = None, batch: str | None = None) -> bool:
    """Append nested feedback to the JSON-lines folder first, then flattened to the store; each vote once.

    A batch has one folder ``batch=...`` in either place, and a mark beside the store when both are in.  A
    job lost between the two runs again with the same rows (or the same ``batch`` name): it replaces its own
    folders and finds votes of other batches by ``feedback_id``, so both places end with every vote once.
    A batch that is marked is not written again; the result tells whether anything was.  The last of
    several votes with one id counts; votes without an id are kept as they are.

    A store that is a table takes the votes whose id it does not hold.
    """
    from catalogmatch.sources.readers import flatten_feedback

    spark = nested.sparkSession
    path = shared_dir(spark, "feedback-batch")
    order = Window.partitionBy("feedback_id").orderBy(F.desc("timestamp"), F.desc(F.to_json(F.struct(*nested.columns))))
    last = nested.where("feedback_id is not null").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    last.unionByName(nested.where("feedback_id is null")).write.parquet(path)
    rows = spark.read.schema(nested.schema).parquet(path)  # both places get these
    if batch is None:
        seen = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("feedback_id")).alias("h")).first()
        batch = f"{seen.n}-{(seen.h or 0) & (2**64 - 1):016x}"
    mark = f"{target.rstrip('/')}-batches/{batch}" if "/" in target else f"{jsonl.rstrip('/')}-batches/{batch}" if jsonl else None
    if mark and versions.exists(spark, f"{mark}/_SUCCESS"):
        return False
    if jsonl:
        fresh = _unseen(rows, _other_batches(spark, jsonl, batch, "json"))
        fresh.write.mode("overwrite").json(f"{jsonl}/batch={batch}", timestampFormat=JSON_TIME)
    if "/" in target:
        fresh = flatten_feedback(_unseen(rows, _other_batches(spark, target, batch, "parquet")))
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch}")
    else:
        sink_append(flatten_feedback(_unseen(rows, spark.table(target) if spark.catalog.tableExists(target) else None)), target)
    if mark:
        spark.range(0).write.mode("overwrite").parquet(mark)
    return True


def export_results(results: DataFrame, path: str) -> None:
    """Write search results as CSV with a header, each query's rows together and in rank order."""
    (
        results.repartition("query_id").sortWithinPartitions("query_id", "rank")
        .write.mode("overwrite").csv(path, header=True, escape='"', **KEEP_BLANKS)
    )


TABLES: dict[str, StructType] = {
    "catalog_display": schemas.CATALOG_DISPLAY,
    "catalog_processed": schemas.CATALOG_PROCESSED,
    "item_vectors": schemas.ITEM_VECTORS,
    "unit_map": schemas.UNIT_MAP,
    "feedback": schemas.FEEDBACK,
}


def ensure_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the five stores where they do not exist yet; running it again changes nothing."""
    names = []
    for name, schema in TABLES.items():
        columns = ", ".join(
            f"{f.name} {f.dataType.simpleString()}"
            + (" DEFAULT current_timestamp()" if f.name in ("updated_at", "created_at") else "")
            for f in schema
        )
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
        names.append(f"{database}.{name}")
    return names
