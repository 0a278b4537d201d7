"""Sharding by a two-pass external shuffle.

First pass: a seeded hash picks the shard of every record by rendezvous (the shard whose hash with
the record's id is highest), and another hash scatters the records of a shard evenly into buckets of
about ``BUCKET_BYTES``, as many as the bytes of the shard ask for, so none outgrows a task even where one id
has a third of all records.  Second
pass: each bucket is put in order and shuffled with Fisher-Yates (Spark's ``shuffle``), and its place
in the shard follows from the sizes of the buckets before it.  The records themselves, texts and all
columns, go through both passes; only counts by id and hash are taken beforehand.  DataFrame functions only.

The law that holds is ``key``: the id and the number of shards decide the shard, and one more shard
takes records only into itself.  Records equal in every column are carried once, numbered and scattered by
that number too, so not even a million copies of one record meet in one bucket.

The order is repeatable: buckets are sorted inside a number of partitions that follows from the data before
the seeded shuffle, so a task that runs again, and a cluster of another size, give the same rows.

Defined results: a null text has no bytes and checksum 0; records without ``doc_id`` share one shard;
an empty table gives no rows; other columns, whatever their names, tell records apart and travel with them.
A text of any length travels whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalogmatch.llm.staging import stage

SHARDS = 40
SEED = 20_240_611
BUCKET_BYTES = 16 << 20
MOST_TASKS = 2_000
OVERHEAD = 16


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard from 0 to ``shards - 1`` whose hash with ``key`` is highest."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(F.xxhash64(F.lit(seed), k, key).alias("draw"), k.alias("shard")))
    return F.array_max(draws)["shard"]


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, size, text_crc32, record, law, shard, slot, grown_shard, row`` of every record, moved to its place.

    ``row`` holds the record with all its columns, ``record`` a hash of them; ``slot`` runs from 0 without
    gaps in each shard; ``grown_shard`` is the shard with one shard more.  Size and checksum are those of the
    text that arrived.
    """
    keyed = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns]).alias("record"),
        *_measures(docs["text"]), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    counted = stage(keyed.groupBy("doc_id", "size", "text_crc32", "record").count(), "shards-records")
    sums = counted.groupBy(rendezvous(F.col("doc_id"), shards, seed).alias("shard")).agg(F.sum(F.col("size") * F.col("count")).alias("bytes"))
    held = {row["shard"]: row["bytes"] for row in sums.collect()}  # a row for each shard
    buckets = [max(1, -(-held.get(k, 0) // bucket_bytes)) for k in range(shards)]
    own = F.element_at(F.array(*[F.lit(n) for n in buckets]), F.col("shard") + 1)
    scatter = F.xxhash64(F.lit(seed + 1), "doc_id", "record", "copy")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", rendezvous(F.col("doc_id"), shards, seed)).withColumn("bucket", F.pmod(scatter, own).cast("long"))

    def copies(rows: DataFrame) -> DataFrame:
        return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")

    # where each bucket starts in its shard follows from the ids and hashes; at most one row for each bucket
    sizes = placed(copies(counted)).groupBy("shard", "bucket").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "bucket", before.alias("start"))

    # first pass: equal records are carried once up to their numbering, so copies never meet in one task
    columns = ["doc_id", "record", "copy", "row"]
    carried = keyed.groupBy("record", "size", "text_crc32").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("row").alias("row"), F.count("*").alias("count"))
    each = copies(carried).select(*columns)
    tasks = min(MOST_TASKS, sum(buckets))  # follows from the data alone: ``shuffle`` draws by the number of the task
    lists = placed(each).repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").agg(
        F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 2), "record", "copy").alias("draw"), *columns))).alias("held"))
    mixed = lists.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("held", F.lit(seed)).alias("held"))
    out = mixed.join(F.broadcast(starts), ["shard", "bucket"]).select("shard", "start", F.posexplode("held").alias("at", "held"))
    out = out.select("shard", "start", "at", "held.*")
    grown = F.xxhash64(F.lit(seed), F.lit(shards), "doc_id") > F.xxhash64(F.lit(seed), F.col("shard"), "doc_id")
    return out.select(
        "doc_id", *_measures(F.col("row.text")), "record", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"),
        F.when(grown, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("grown_shard"), "row")


def _measures(text: Column) -> tuple[Column, Column]:
    """Size of a record and checksum of its text."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    return size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
                 file_rows: int = 100_000) -> None:
    """Write ``docs`` below ``path`` as ``shard=N`` folders, rows in the order of their slots.

    A shard is cut into files of ``file_rows`` rows that follow each other, so no task holds a shard.
    """
    placed = shard(docs, shards, seed, bucket_bytes)
    rows = placed.select("row.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows = rows.withColumn("__file", F.floor(F.col("__slot") / file_rows))
    rows = rows.repartitionByRange("__shard", "__file").sortWithinPartitions("__shard", "__slot")
    rows.drop("__file").withColumnsRenamed({"__shard": "shard", "__slot": "slot"}).write.partitionBy("shard").parquet(path)
