"""Five stages from raw documents to token ids, each over all that the stage before it kept.

All but the last return the columns of ``documents``: quality classifier, line dedup, SimHash near-dedup, mixing,
byte-pair encoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import bpe, common, cotraining, line_dedup, mixing, near_copies
from heronry.llm.registry import word_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words in a shingle of the near-duplicate stage, and bits in which fingerprints of its first candidates may differ.
SHINGLE, RADIUS = 5, 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers don't reject."""
    common.bound_batches(spark)
    model = cotraining.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = common.free_name(docs, "scores")
    scored = cotraining.score_documents(docs, model, name)
    return scored.filter(F.col(f"{name}.quality") >= cotraining.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble earlier ones; those that lose every line go."""
    common.bound_batches(spark)
    return line_dedup.remove_later_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarities of 0.8 or more of their shingle sets."""
    common.bound_batches(spark)
    return near_copies.keep_one(docs, radius=RADIUS, width=SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of their sources' weights, repeated where a target asks for it."""
    common.bound_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the text decoded from them."""
    common.bound_batches(spark)
    return bpe.digests(bpe.encode_documents(docs.select("doc_id", "text"), word_tokenizer()))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: A fitted model, XXH64 and the tokenizer take part: tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of ``sf_dir``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
