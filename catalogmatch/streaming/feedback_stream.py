"""Live feedback statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalogmatch.sources import versions


def feedback_stream_stats(feedback: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Votes, approvals and rejections per time window of a feedback stream.

    A vote delivered twice within ``delay`` counts once; state older than that is dropped.  In
    append mode a window is emitted when the watermark passes its end, so windows still open at
    the end of the input stay in the state.  A vote without a label counts as rejected.
    """
    timed = feedback.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    unique = timed.withWatermark("timestamp_utc", delay).dropDuplicatesWithinWatermark(["feedback_id"])
    counted = unique.groupBy(F.window("timestamp_utc", window).alias("w")).agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("approved"))
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total", "approved", (F.col("total") - F.col("approved")).alias("rejected"),
    )


def hourly(votes: DataFrame, window: str = "1 hour") -> DataFrame:
    """Votes, approvals and rejections per time window of stored votes, each ``feedback_id`` once."""
    unique = votes.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp")).groupBy("feedback_id").agg(
        F.min(F.struct("timestamp_utc", "label")).alias("vote"))
    counted = unique.groupBy(F.window("vote.timestamp_utc", window).alias("w")).agg(
        F.count("*").alias("total"), F.count_if(F.col("vote.label") == 1).alias("approved"))
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total", "approved", (F.col("total") - F.col("approved")).alias("rejected"))


def collect_votes(feedback: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Store what counts per window need of each vote, one folder per batch.

    A batch that runs again replaces its own folder.  ``hourly`` over the store is complete at any time,
    and reads all of it; ``count_votes`` keeps the counts themselves.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("feedback_id", "timestamp_utc", "label").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return feedback.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: every so many batches all windows are written again, so a reader goes back no further
COMPACT = 32


def _latest(counts: DataFrame) -> DataFrame:
    """The last state of every window in the folders of several batches."""
    last = F.max_by(F.struct("window_end", "total", "approved"), "batch").alias("last")
    return counts.groupBy("window_start").agg(last).select("window_start", "last.*")


def _batches(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """Counts of the batches from the last full one on."""
    known = [int(name.removeprefix("batch=")) for name in versions.children(spark, target) if name.startswith("batch=")]
    known = [b for b in known if before is None or b < before]
    full = max((b for b in known if b % COMPACT == 0), default=None)
    return None if full is None else spark.read.schema(_COUNTS).parquet(target).where(F.col("batch").between(full, max(known)))


_COUNTS = "window_start timestamp, window_end timestamp, total bigint, approved bigint, batch int"


def count_votes(feedback: DataFrame, target: str, checkpoint: str, window: str = "1 hour") -> StreamingQuery:
    """Keep the counts of every window current, one folder per batch with the windows that it changed.

    Which votes have been counted is the query's state, so a batch costs what its own votes cost, whatever
    came before; a vote delivered again counts once (as it came first), however late, and a late vote
    changes its window.  The state holds every ``feedback_id``; for long histories choose Spark's RocksDB
    state store, which keeps it on disk.  A batch that runs again replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = batch.select("w.start", "w.end", "total", "approved").toDF("window_start", "window_end", "total", "approved")
        known = _batches(spark, target, batch_id) if batch_id % COMPACT == 0 else None
        if known is not None:
            changed = _latest(known.unionByName(changed.withColumn("batch", F.lit(batch_id))))
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    timed = feedback.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    counted = timed.dropDuplicates(["feedback_id"]).groupBy(F.window("timestamp_utc", window).alias("w")).agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("approved"))
    return (counted.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def live_counts(spark: SparkSession, target: str) -> DataFrame:
    """Counts per window of all votes that ``count_votes`` has seen; windows still open are in it."""
    known = _batches(spark, target)
    counts = _latest(known if known is not None else spark.createDataFrame([], _COUNTS))
    return counts.withColumn("rejected", F.col("total") - F.col("approved"))
