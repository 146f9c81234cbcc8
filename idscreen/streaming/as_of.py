"""Records looked up in a registry whose versions arrive as a stream too."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Payloads travel as JSON; times keep their microseconds.
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The state store that list state and timers need, for the queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class LatestVersion(StatefulProcessor):
    """State of one key: versions that a record can still need, and records that a version can still come for.

    A record waits until the watermark has reached its time; then no version with an earlier time can come any more. Of the
    versions before the watermark only the latest is kept. A timer stands at the earliest waiting record.
    """

    def __init__(self, tie_type: str) -> None:
        self._tie_type = tie_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._versions = handle.getListState("versions", f"at BIGINT, tie {self._tie_type}, payload STRING")
        self._waiting = handle.getListState("waiting", "at BIGINT, payload STRING")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        versions, waiting, timeless = [], [], []
        for frame in rows:
            for is_record, at, tie, payload in zip(frame["is_record"], frame["micros"], frame["tie"], frame["payload"]):
                if not is_record:
                    versions.append((int(at), None if pd.isna(tie) else tie if isinstance(tie, str) else int(tie), payload))
                elif pd.isna(at):
                    timeless.append(payload)
                else:
                    waiting.append((int(at), payload))
        if versions:
            self._versions.appendList(versions)
        if waiting:
            self._waiting.appendList(waiting)
            self._handle.registerTimer(min(at for at, _ in waiting) // 1_000 + 1)
        if timeless:
            yield pd.DataFrame({"record": timeless, "version": [None] * len(timeless)})

    def handleExpiredTimer(  # noqa: N802
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1_000
        waiting = sorted((tuple(r) for r in self._waiting.get()), key=lambda r: r[0]) if self._waiting.exists() else []
        versions = [tuple(v) for v in self._versions.get()] if self._versions.exists() else []
        versions.sort(key=lambda v: (v[0], v[1] is not None, v[1]))
        due = [r for r in waiting if r[0] <= reached]
        rest = waiting[len(due) :]
        found, place = [], -1
        for at, _ in due:
            while place + 1 < len(versions) and versions[place + 1][0] <= at:
                place += 1
            found.append(versions[place][2] if place >= 0 else None)
        passed = sum(v[0] <= reached for v in versions)
        self._versions.put(versions[max(0, passed - 1) :]) if passed > 1 else None
        if rest:
            self._waiting.put(rest)
            self._handle.registerTimer(rest[0][0] // 1_000 + 1)
        else:
            self._waiting.clear()
        if due:
            yield pd.DataFrame({"record": [p for _, p in due], "version": found})

    def close(self) -> None:
        pass


def live_registry_as_of(
    records: DataFrame,
    versions: DataFrame,
    key: str,
    ts: str,
    *,
    record_order: str,
    version_ts: str,
    version_order: str,
    values: Sequence[str],
    delay: str,
    valid_to: str | None = None,
    spread: int = 1,
) -> DataFrame:
    """`registry_as_of` on two streams: each record with the latest version that started at or before its time.

    Both times are timestamps. A record comes out once the watermark, the latest time seen on the slower of the two streams
    less `delay`, has passed its time, so a version that arrives in a later file, or late by less than the delay, still counts.
    Records or versions later than that are dropped and counted (`run_once`). State holds, for each key, the
    records and versions of about the delay and one older version. `version_order` is a whole number or a string. With `spread` above 1 the
    records of one key are dealt over that many tasks by `record_order` and the versions go to each.

    Start the query inside `rocksdb_state`. A record without key or time has no version; a version without either is
    never looked at.
    """
    kept = [*values, valid_to] if valid_to else list(values)
    tie_type = "string" if versions.schema[version_order].dataType.simpleString() == "string" else "bigint"
    record, version = F.struct(*records.columns), F.struct(F.col(version_ts).alias("_from"), *kept)
    record_type = records.select(record.alias("r")).schema["r"].dataType
    version_type = versions.select(version.alias("v")).schema["v"].dataType
    mine = records.withWatermark(ts, delay).select(
        F.col(key).alias("key"),
        F.pmod(F.xxhash64(record_order), F.lit(spread)).cast("int").alias("part"),
        F.col(ts).alias("at"),
        F.unix_micros(ts).alias("micros"),
        F.lit(True).alias("is_record"),
        F.lit(None).cast(tie_type).alias("tie"),
        F.to_json(record, _JSON).alias("payload"),
    )
    theirs = versions.where(F.col(key).isNotNull() & F.col(version_ts).isNotNull()).withWatermark(version_ts, delay).select(
        F.col(key).alias("key"),
        F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"),
        F.col(version_ts).alias("at"),
        F.unix_micros(version_ts).alias("micros"),
        F.lit(False).alias("is_record"),
        F.col(version_order).cast(tie_type).alias("tie"),
        F.to_json(version, _JSON).alias("payload"),
    )
    looked_up = (
        mine.unionByName(theirs)
        .groupBy("key", "part")
        .transformWithStateInPandas(LatestVersion(tie_type), "record STRING, version STRING", "Append", "EventTime")
    )
    parsed = looked_up.select(
        F.from_json("record", record_type, _JSON).alias("_record"), F.from_json("version", version_type, _JSON).alias("_found")
    )
    usable = F.lit(True)
    if valid_to:
        ended = F.col(f"_found.{valid_to}")
        usable = ended.isNull() | (ended > F.col(f"_record.{ts}"))
    return parsed.select(
        "_record.*",
        F.when(usable, F.col("_found._from")).alias("version_from"),
        *[F.when(usable, F.col(f"_found.{v}")).alias(v) for v in values],
    )
