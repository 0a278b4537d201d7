"""Read catalog, vector and feedback stores.

A source is a table name or a path; anything with a slash in it is a parquet path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogmatch import schemas
from catalogmatch.operators import sets
from catalogmatch.sources import versions


def read_store(spark: SparkSession, source: str, schema: StructType | None = None) -> DataFrame:
    """A table by name, or parquet files below a path read with the declared schema."""
    if "/" not in source:
        return spark.table(source)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(source)


def read_small(spark: SparkSession, source: str, schema: StructType | None = None) -> DataFrame:
    """What ``sink_replace_small`` published last; a path without versions is read as it is."""
    known = versions.complete(spark, source) if "/" in source else []
    return read_store(spark, versions.folder(source, known[-1]) if known else source, schema)


def scan_catalog(spark: SparkSession, source: str) -> DataFrame:
    """The raw item table."""
    return read_store(spark, source, schemas.CATALOG_RAW)


def scan_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw items from CSV with a header; quoted line breaks and doubled quotes are understood."""
    return spark.read.schema(schemas.CATALOG_RAW).csv(
        path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)


def scan_gold(spark: SparkSession, path: str) -> DataFrame:
    """Expected item per query from CSV with a header; the expected id may be blank."""
    return spark.read.schema(schemas.GOLD).csv(path, header=True, quote='"', escape='"')


def scan_ids(vectors: DataFrame) -> DataFrame:
    """Only the id column of the vector store; the vectors are never read."""
    return vectors.select("cd_insumo")


def scan_display(display: DataFrame) -> DataFrame:
    """The display table without its bookkeeping column."""
    return display.drop("updated_at")


def scan_items_with_vectors(processed: DataFrame, vectors: DataFrame) -> DataFrame:
    """All processed items joined with their vectors."""
    return sets.join_vectors(processed, vectors).select(
        "grp_insumo", "cd_insumo", "insumo_descricao", "marca", "medida", "vector")


def scan_items_by_ids(processed: DataFrame, vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The same for a table of ids; both sides are cut to the ids before they meet."""
    return scan_items_with_vectors(
        sets.rows_with_ids(processed, ids), sets.rows_with_ids(vectors, ids))


def scan_feedback(feedback: DataFrame) -> DataFrame:
    """Stored feedback in time order under its dotted reading names."""
    names = schemas.FEEDBACK_READ_NAMES
    return feedback.orderBy("timestamp_utc", "feedback_id").withColumnsRenamed(names)


def scan_feedback_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Nested feedback lines, flattened to the stored columns.  Blank lines are skipped."""
    return flatten_feedback(spark.read.schema(schemas.FEEDBACK_NESTED).json(path))


def flatten_feedback(nested: DataFrame) -> DataFrame:
    """Nested feedback records to the 22 stored columns; no snapshot becomes an empty object."""
    names = schemas.FEEDBACK_READ_NAMES
    stored = [c for c in schemas.FEEDBACK.names if c != "weights_snapshot"]
    empty = F.create_map().cast("map<string,double>")
    snapshot = F.parse_json(F.to_json(F.coalesce("weights_snapshot", empty)))
    return nested.select(
        *[F.col(names.get(c, c)).alias(c) for c in stored],
        snapshot.alias("weights_snapshot"),
    )


def vector_from_json(df: DataFrame, col: str, out: str = "vector") -> DataFrame:
    """Vectors stored as JSON text to float arrays."""
    return df.withColumn(out, F.from_json(F.col(col), "array<float>"))


def vector_to_json(df: DataFrame, col: str = "vector", out: str = "vector_json") -> DataFrame:
    """Float arrays to JSON text."""
    return df.withColumn(out, F.to_json(F.col(col)))
