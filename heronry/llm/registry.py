"""Queries of this subpackage over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heronry.llm import anchors, bpe, conversations, cotraining, language, line_dedup, line_rules, mixing, multi_index, simhash, suffixes, warc, zone_maps
from heronry.llm.common import documents


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two views that label for each other."""
    return cotraining.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that go because they resemble earlier ones."""
    return line_dedup.report(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_report(documents(spark, sf_dir))


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of every page, written as archives and read back."""
    return warc.archive_report(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.report(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return language.language_report(documents(spark, sf_dir))


def word_tokenizer() -> str:
    """The public tokenizer's file; the package that holds it is on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(bpe.encode_documents(docs, word_tokenizer()))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document by rules for its lines."""
    return line_rules.quality_report(documents(spark, sf_dir))


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    return multi_index.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in strings of 400 bytes found elsewhere."""
    return suffixes.report(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired rows of every conversation of ``conversations``."""
    return conversations.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return anchors.report(documents(spark, sf_dir))


def op13_zone_map_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance and inertias of every vector of ``embeddings``."""
    return zone_maps.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining_quality": op1_cotraining_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_warc_segments": op4_warc_segments,
    "op5_covering_simhash": op5_covering_simhash,
    "op6_language_id": op6_language_id,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_line_rules": op8_line_rules,
    "op9_multi_index_hashing": op9_multi_index_hashing,
    "op10_suffix_merge": op10_suffix_merge,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_anchor_expansion": op12_anchor_expansion,
    "op13_zone_map_clustering": op13_zone_map_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": mixing.MIX_SQL,
    "op4_warc_segments": warc.ARCHIVE_SQL,
    "op11_conversation_repair": conversations.REPAIR_SQL,
    "op13_zone_map_clustering": zone_maps.CLUSTER_SQL,
}
