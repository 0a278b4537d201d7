"""The registered queries of this subpackage, one per operator, and the SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm import bpe, decontaminate, jaccard, lines, pack, phrases, private, quality, ranked, repeats, shards, suffixes, urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def byte_bpe_path() -> str:
    """The byte-level BPE file of the public tokenizers; only the driver opens it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_register
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.encode(_documents(spark, sf_dir), byte_bpe_path(), digest=True)


@_register
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


TWINS["op4_url_filter"] = urls.twin()


@_register
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the windows of 13 words that an earlier document has."""
    return repeats.remove_repeats(_documents(spark, sf_dir), digest=True)


TWINS["op7_substring_dedup"] = repeats.twin()


@_register
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are at least three quarters alike."""
    return jaccard.jaccard_components(_documents(spark, sf_dir))


TWINS["op8_jaccard_join"] = jaccard.twin()


@_register
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, quality.fit(docs, labels))


@_register
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item that each document covers, if any."""
    return decontaminate.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_register
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template an earlier document has."""
    kept = lines.drop_recurring_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


TWINS["op1_line_dedup"] = lines.twin()


@_register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shards.shard(_documents(spark, sf_dir).select("doc_id", "text")).drop("record", "row")


@_register
def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates in place of personal data."""
    return private.replace_private(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_entities", "text")


@_register
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, packed into rows of 2048."""
    return pack.pack(_documents(spark, sf_dir), byte_bpe_path())


@_register
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TWINS["op12_ranked_search"] = ranked.twin()


@_register
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return phrases.collocations(_documents(spark, sf_dir))


TWINS["op13_collocations"] = phrases.twin()


@_register
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that also start anywhere else."""
    return suffixes.remove_repeated_bytes(_documents(spark, sf_dir), digest=True)
