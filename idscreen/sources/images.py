"""Image files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_images(spark: SparkSession, path: str, glob: str | None = None, keep_content: bool = False) -> DataFrame:
    """(path, modified, length, digest) of the files below `path`; with `keep_content` also their bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    columns = ["path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("digest")]
    return files.select(*columns, *(["content"] if keep_content else []))
