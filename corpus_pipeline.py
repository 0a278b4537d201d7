"""From documents to tokens: quality rules, line dedup, near-duplicate join, decontamination, encoding.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the
last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet below
``spark.checkpoint.dir`` and hands the written rows to the next, so a lost executor never reaches back
beyond one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm import bpe, decontaminate, jaccard, lines, quality
from catalogmatch.llm.registered import byte_bpe_path
from catalogmatch.llm.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the limits and the isolation forest keep, with all their columns.

    A null or empty text fails the limits and goes; rows alike are kept or go alike; ids may be shared or null
    (labels then name none); an empty table stays empty; a text of any length is counted whole.  Columns may
    have any names but ``text`` and ``doc_id``, which are read.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template an earlier document has; those left blank go."""
    kept = lines.drop_recurring_lines(docs, ("__lines", "__dropped"))
    kept = kept.where((F.col("__dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).drop("__lines", "__dropped")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with the smallest id, rows without id last, then by a hash of the text.

    Rows are told apart by a hash of id and text, so texts that share an id, or have none, link and go each
    by itself.  Of rows alike in id and text one stays, the one least as JSON.  What links with nothing stays, so do
    texts without words; an empty table stays empty; columns may be of any type and named like those used here.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", F.struct(*columns).alias("row"))
    found = jaccard.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text")).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    ids = keyed.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    rows = stage(found.join(ids, "key"), "pipeline-rows")
    heads = stage(rows.groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("head"), F.sum("n").alias("all"))
        .where("all > 1").select("component", F.col("head.key").alias("kept")), "pipeline-heads")
    judged = rows.join(heads, "component")
    gone = judged.where("key <> kept or n > 1").select("key")
    again = judged.where("key = kept and n > 1").select("key")
    one = keyed.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return keyed.join(gone, "key", "left_anti").select("row.*").unionByName(one.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item covers, with all their columns.

    A null or empty text is covered by nothing and stays; rows alike stay or go alike, whatever their ids; an empty
    table, or an empty benchmark, changes nothing; a text of any length is searched whole.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of every document, with digests of its ids and of the text decoded from them.

    One row for each row: a null text is the empty one and has no tokens; ids may be shared or null; an empty
    table gives no rows; other columns are left out; a text of any length is encoded whole.
    """
    return bpe.encode(docs, byte_bpe_path(), digest=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The forest and the tokenizer are beyond SQL; a test compares the stages with brute force.
ORACLE_SQL = None
