"""Screening events as a stream. Every stateful operator takes a delay, which bounds its state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idscreen.operators.registry import registry_check
from idscreen.sources.scratch import fresh_dir


_REPORTS = "spark.sql.streaming.numRecentProgressUpdates"
KEPT_REPORTS = 10_000


@dataclass(frozen=True)
class StreamRun:
    batches: int
    rows_in: int
    rows_late: int
    path: str


def read_events(
    spark: SparkSession, directory: str, schema: str, ts: str, glob: str = "*.parquet", files_per_batch: int = 1_000
) -> DataFrame:
    """Parquet files of a folder as a stream; `ts` becomes a timestamp, as watermarks need."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    stream = reader.option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def run_once(df: DataFrame, out: str, checkpoint: str, name: str | None = None) -> StreamRun:
    """Process all input there is now into parquet files at `out`, then stop. Tells how many rows came too late."""
    spark = df.sparkSession
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if name:
        writer = writer.queryName(name)
    # a query keeps the number of reports that holds when it starts; that must be enough for all batches between two looks
    before = spark.conf.get(_REPORTS, None)
    spark.conf.set(_REPORTS, str(max(int(before or 0), KEPT_REPORTS)))
    try:
        query = writer.trigger(availableNow=True).start(out)
    finally:
        spark.conf.unset(_REPORTS) if before is None else spark.conf.set(_REPORTS, before)
    seen: dict[tuple, object] = {}

    def gather() -> None:
        seen.update({(p.batchId, p.timestamp): p for p in query.recentProgress})

    while not query.awaitTermination(1):
        gather()
    gather()
    progress = list(seen.values())
    return StreamRun(
        batches=len(progress),
        rows_in=sum(p.numInputRows for p in progress),
        rows_late=sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators),
        path=out,
    )


def finish(df: DataFrame) -> DataFrame:
    """Run a stream over the input there is and give its output as a batch frame."""
    spark = df.sparkSession
    run = run_once(df, fresh_dir(spark, "stream-out"), fresh_dir(spark, "stream-state"))
    return spark.read.schema(df.schema).parquet(run.path)


def window_counts(
    stream: DataFrame, ts: str, by: Sequence[str], size: str, slide: str | None, delay: str
) -> DataFrame:
    """Rows per window and key, given out once the watermark has passed the window's end."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = stream.withWatermark(ts, delay).groupBy(window, *by).agg(F.count(F.lit(1)).alias("events"))
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "events"
    )


def live_sessions(stream: DataFrame, case: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Runs of a case's events no more than `gap` apart, once no event can join them."""
    grouped = stream.withWatermark(ts, delay).groupBy(case, F.session_window(ts, gap))
    found = grouped.agg(F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events"))
    return found.select(case, F.col("session_window.start").alias("session_start"), "session_end", "events")


def drop_repeats(stream: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """The first arrival per key; repeats within the delay are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def live_registry_check(
    stream: DataFrame, registry: DataFrame, keys: Sequence[str], compare: Sequence[str]
) -> DataFrame:
    """The registry check on a stream. The registry's files are listed once, when its frame is made."""
    return registry_check(stream, registry, keys, compare)


def join_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    span: str,
    delay: str,
    spread: int = 1,
    spread_by: str | None = None,
) -> DataFrame:
    """Pairs of a left row and a right row of the same key that follows it within `span`.

    Both sides keep rows only as long as a partner can still come. With `spread` above 1 the left rows of one key are
    dealt over that many tasks by `spread_by` and the right rows go to each, so that a hot key is not one task.
    """
    a = left.withWatermark(left_ts, delay)
    b = right.withWatermark(right_ts, delay)
    dealt = F.pmod(F.xxhash64(spread_by or left_ts), F.lit(spread))
    a = a.select("*", dealt.cast("int").alias("_part"))
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_part"))
    same: list[Column] = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_part"]]
    in_time = (F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}")) & (
        F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}") + F.expr(f"INTERVAL {span}")
    )
    condition = in_time
    for eq in same:
        condition = condition & eq
    joined = a.alias("a").join(b.alias("b"), condition)
    mine = [F.col(f"a.{c}") for c in left.columns]
    theirs = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return joined.select(*mine, *theirs)
