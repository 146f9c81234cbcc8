"""Exact duplicates through a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is digested where it is read, folded to one row per
text, sort-merge anti-joined with the index and appended. Later batches read only digests, never old texts.

Cases: a null text counts as empty; a null id ranks below every other; rows equal in id and text are one document
repeated, of which one stays; an empty batch appends nothing; columns besides id and text are never looked at, so
their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from idscreen.llm.shared import free_name, keep_one, materialise

BUCKETS = 64
HOT_ROWS = 1_000
HOT_SHARE = 10_000
_MARK = "_buckets-"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: Column) -> Column:
    """SHA-256 of a text with A-Z lower-cased. `lower` does the same on texts without other characters, and faster."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.unhex(F.sha2(lowered, 256))


def _folded(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(digest, doc_id, n): n rows have this id and this text. Copies in one task are folded before the shuffle."""
    rows = docs.select(digest_of(F.col(text)).alias("digest"), F.col(id_col).alias("doc_id"))
    return rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def _append(rows: DataFrame, index: str) -> None:
    spark = rows.sparkSession
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {index}").where("col_name = 'Num Buckets'").first()["data_type"])
    placed = rows.repartition(buckets, "digest")
    placed.write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").mode("append").saveAsTable(index)


def index_folder(spark: SparkSession, index: str) -> str:
    """Where an index of this name has its files: a folder of the warehouse, which all sessions and executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{index}"


def open_index(spark: SparkSession, index: str, id_type: StructField, buckets: int = BUCKETS) -> DataFrame:
    """The index table (digest, keep_id, batch_id), made empty when there is none yet.

    The files are the index; a session whose catalog does not know them, because another session made them, declares the table over
    them again. How many buckets they have is in the name of an empty file beside them, which readers pass over.
    """
    if not spark.catalog.tableExists(index):
        folder = index_folder(spark, index)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        marks = [name for name in there if name.startswith(_MARK)]
        if marks:
            buckets = int(marks[0].removeprefix(_MARK))
        else:
            files.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{_MARK}{buckets}"), True).close()
        spark.sql(
            f"CREATE TABLE {index} (digest BINARY, keep_id {id_type.dataType.simpleString()}, batch_id STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(index)


def add_batch(
    docs: DataFrame, index: str, batch_id: str, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """Enter a batch in the index. Returns its folded rows (digest, doc_id, n) and its texts (digest, keep_id,
    group_size, is_new).

    Of equal texts in the batch the row with the largest id is entered; a text that an earlier batch entered is not
    new. A batch entered again under the same `batch_id`, say after a failed run, adds nothing and gives the same
    answer as the first time.
    """
    spark = docs.sparkSession
    rows = materialise(_folded(docs, id_col, text), "digests")
    known = open_index(spark, index, rows.schema["doc_id"], buckets)
    texts = rows.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.sum("n").alias("group_size"))
    unseen = texts.join(known.select("digest").hint("merge"), "digest", "left_anti")
    _append(unseen.select("digest", F.col("last_id").alias("keep_id"), F.lit(batch_id).alias("batch_id")), index)
    spark.catalog.refreshTable(index)
    entered = texts.join(spark.table(index).hint("merge"), "digest").select(
        "digest", "keep_id", "group_size", (F.col("batch_id") == batch_id).alias("is_new")
    )
    return rows, entered


def decisions(rows: DataFrame, entered: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    A text of more than `hot_rows` rows that also holds over a ten-thousandth of the batch is looked up by broadcast,
    all others by sort-merge join. At most 10,000 texts can be that frequent, so the broadcast side is bounded.
    """
    total = rows.agg(F.sum("n")).first()[0] or 0
    hot_size = max(hot_rows, total // HOT_SHARE)
    hot = entered.where(F.col("group_size") > hot_size)
    cold = entered.where(F.col("group_size") <= hot_size)
    joined = rows.join(cold.hint("merge"), "digest").unionByName(rows.join(F.broadcast(hot), "digest"))
    first = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # a repeated row comes back as often as it was there; one of the repetitions stays
    return joined.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("bigint").alias("group_size"),
        (first & (F.col("_k") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_new(
    docs: DataFrame, index: str, batch_id: str, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """The rows of a batch that stay, with all their columns."""
    rows, entered = add_batch(docs, index, batch_id, id_col, text, buckets)
    first = entered.where("is_new").select(F.col("digest").alias("_d"), F.col("keep_id").alias("_keep"))
    same = (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_keep"))
    stay = rows.join(first, same).select(F.col("digest").alias("key"), "doc_id", "n")
    name = free_name(docs, "digest")
    kept = keep_one(docs.withColumn(name, digest_of(F.col(text))), id_col, F.col(name), stay)
    return kept.drop(name)
