"""The trail on disk: parquet by batch and day, written once."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idscreen.functions import digest as dg


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often. Only row digests are shuffled."""
    columns = a.columns
    counted = a.select(dg.row_text(columns).alias("_row"), F.lit(1).alias("_side")).unionByName(
        b.select(dg.row_text(columns).alias("_row"), F.lit(-1).alias("_side"))
    )
    digests = counted.groupBy(F.sha2("_row", 256).alias("_row")).agg(F.sum("_side").alias("_net"))
    return digests.where("_net <> 0").isEmpty()


def trail_append(events: DataFrame, path: str, batch_id: str, ts: str) -> None:
    """Write one batch. A batch that is there already is left as it is: if the rows are the same, as in a rerun, nothing
    is done, and other rows are refused, because a trail is only ever added to.

    Files are written in a folder that readers pass over, and the whole batch appears by one rename, so a lost run leaves no
    half batch. Rows are rebalanced, so a day with most of the batch is written by several tasks.
    """
    spark = events.sparkSession
    days = events.withColumn("event_date", F.col(ts).cast("date"))
    target, files = _files(spark, f"{path}/batch_id={quote(batch_id, safe='')}")

    def check() -> None:
        there = spark.read.schema(days.schema).parquet(target.toString())
        if not same_rows(there, days):
            raise ValueError(f"batch {batch_id!r} is in the trail with other rows")

    if files.exists(target):
        check()
        return
    waiting = f"{path}/_waiting-{uuid.uuid4().hex}"
    days.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(waiting)
    source, _ = _files(spark, waiting)
    # where another writer was faster, a rename fails or goes below its folder; then what is there decides
    below = spark._jvm.org.apache.hadoop.fs.Path(target, source.getName())
    if files.exists(target) or not files.rename(source, target) or files.exists(below):
        files.delete(source, True)
        files.delete(below, True)
        check()


def read_trail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`schema` is that of the events; day and batch come from the folders and prune the scan."""
    return spark.read.schema(f"{schema}, event_date DATE, batch_id STRING").parquet(path)
