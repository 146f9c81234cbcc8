"""The training-text pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idscreen.llm import bag_minhash, byte_bpe, exact_dedup, mixing, quality_classifier
from idscreen.llm.queries import KEEP_SCORE, quality_weights
from idscreen.llm.shared import free_name, materialise
from idscreen.sources.tables import table


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULT, BATCH_ROWS = "10000", "500"


def short_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python tasks; batches of Spark's default number of rows would hold tens of megabytes of them in
    every task. A number that the user has set is left alone."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more stay; it learns from `labels` and this stage's own documents."""
    short_batches(spark)
    score = free_name(docs, "score")
    scored = quality_classifier.add_score(docs, quality_weights(spark, docs, sf_dir), "text", score)
    return scored.where(F.col(score) >= KEEP_SCORE).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id stays."""
    run = uuid.uuid4().hex
    return exact_dedup.keep_new(docs, f"pipeline_index_{run}", run)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    short_batches(spark)
    return bag_minhash.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, one row for each pass that takes some."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and their way back to bytes, as digests."""
    short_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode_documents(encoded, ranks))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

# The classifier, the signatures and the encoding are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what is returned is the last stage's table, read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
    return docs
