"""One query per operator, over its whole table and with the parameters meant for production."""

from __future__ import annotations

import uuid

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idscreen.llm import bag_minhash, byte_bpe, collocations, conversations, decontaminate, exact_dedup, licenses, mixing, ngram_ratio, quality_classifier, substring_dedup, token_orc, url_filter
from idscreen.sources.scratch import fresh_dir
from idscreen.sources.tables import table

RULES = [
    url_filter.UrlRule("allow", "com", "/"),
    url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
]
GLOBS = [
    url_filter.UrlGlob("block", "*spam*/**"),
    url_filter.UrlGlob("block", "**/wp-login**"),
    url_filter.UrlGlob("block", "**/cart/**"),
    url_filter.UrlGlob("block", "**.???.html"),
]


KEEP_SCORE = 0.3


def quality_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """Weights learned from `labels.quality`, without the fifth of the ids that is held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality_classifier.train(docs, labels.select("doc_id", F.col("quality").alias("label")))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.add_score(docs, quality_weights(spark, docs, sf_dir), "text", "score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(spark, sf_dir, "documents")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode_documents(encoded, ranks))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run fills an index of its own, since its contract judges the table alone."""
    run = uuid.uuid4().hex
    rows, entered = exact_dedup.add_batch(table(spark, sf_dir, "documents"), f"digest_index_{run}", run)
    return exact_dedup.decisions(rows, entered)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), RULES, GLOBS)


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_orc.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    return token_orc.token_index(token_orc.read_token_files(spark, path))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that `labels` marks as good and not toxic."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return ngram_ratio.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return conversations.repair(rows)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_mixing,
        op3_byte_bpe,
        op4_exact_dedup,
        op5_licenses,
        op6_url_filter,
        op7_bag_minhash,
        op8_substring_dedup,
        op9_token_orc,
        op10_quality_rules,
        op11_conversation_repair,
        op12_collocations,
        op13_decontamination,
    )
}
