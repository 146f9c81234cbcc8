"""Quality rules from built-in functions only: base counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted over all documents: one of the trusted documents, one of the raw
corpus. An n-gram is a run of letters and digits, a run of marks, or two such runs in a row. A document's score is the
mean log ratio of its n-grams, so it does not grow with length, and every document that passes the base rules and
whose score reaches the threshold is kept. No draw, no cap: the same tables give the same verdicts.

Cases: a null text has no words and fails the base rules; a text without n-grams scores 0; without any trusted
document all ratios are 0 and the base rules alone decide; null ids are never trusted; repeated rows are judged alike;
an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idscreen.llm.shared import BLANK, materialise

BUCKETS = 1 << 16
SMOOTHING = 1.0
THRESHOLD = -0.5
MIN_WORDS = 50
MAX_REPEATED = 0.5
# The marks that count as symbols.
SYMBOLS = "[#*$%&|<>]"
_RUNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text that is not null, as an array."""
    return F.array_remove(F.split(text, BLANK), "")


def grams(runs: Column, buckets: int) -> Column:
    """Buckets of the single runs and of the pairs of runs."""
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    single = F.transform(runs, lambda w: bucket(F.xxhash64(w)))
    pairs = F.transform(F.slice(runs, 2, F.size(runs)), lambda w, i: bucket(F.xxhash64(F.get(runs, i), w)))
    return F.concat(single, pairs)


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that is in the text twice or more, first occurrences included.

    Windows are sorted by hash with their places; equal neighbours are repeats. Their places are sorted again, and
    each place adds the words that the one before it does not cover.
    """
    windows = F.transform(
        F.slice(words, 3, F.size(words)),
        lambda w, i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), w).alias("h"), i.alias("p")),
    )

    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
        found = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(found, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"],
        )

    return let(F.sort_array(windows), lambda s: let(places(s), covered)).cast("bigint")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with one array: log(p trusted / p raw) of every bucket, add-`smoothing` smoothed.

    All documents are counted. Texts meet the trusted ids by one join on the id, whose sides both grow; counts are folded in every task
    before they are shuffled, so what is shuffled then is at most `buckets` rows per task.
    """
    marked = docs.join(
        trusted.where("doc_id is not null").select("doc_id").distinct().withColumn("_trusted", F.lit(1)).hint("merge"),
        "doc_id",
        "left",
    ).select(F.regexp_extract_all("text", F.lit(_RUNS), F.lit(0)).alias("_runs"), F.coalesce("_trusted", F.lit(0)).alias("_t"))
    counts = (
        marked.select(F.explode(grams(F.col("_runs"), buckets)).alias("bucket"), "_t")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("_t").alias("trusted"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = materialise(
        every.join(counts, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "trusted")]),
        "ngram-counts",
    )
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).first()
    spread = smoothing * buckets
    ratio = F.log((F.col("trusted") + smoothing) / F.lit(totals["trusted"] + spread)) - F.log(
        (F.col("raw") + smoothing) / F.lit(totals["raw"] + spread)
    )
    known = F.lit(totals["trusted"] > 0)
    ordered = F.array_sort(F.collect_list(F.struct("bucket", F.when(known, ratio).otherwise(0.0).alias("r"))))
    return counts.agg(F.transform(ordered, lambda x: x["r"]).alias("ratios"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ratios = materialise(log_ratios(narrow, trusted, buckets), "ngram-ratios").scalar()
    split = narrow.select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("_words"),
        F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"),
        F.regexp_extract_all("text", F.lit(_RUNS), F.lit(0)).alias("_runs"),
        ratios.alias("_ratios"),
    )
    long = lambda c: c.cast("bigint")
    counted = split.select(
        "doc_id",
        long(F.size("_words")).alias("n_words"),
        long(F.char_length(F.array_join("_words", ""))).alias("word_chars"),
        long(F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        let(
            grams(F.col("_runs"), buckets),
            lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get("_ratios", b)) / F.greatest(F.size(g), F.lit(1)),
        ).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
        "score",
    )
