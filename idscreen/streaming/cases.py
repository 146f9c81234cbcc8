"""Cases that wait for all their signals, with a time limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "case_id STRING, status STRING, first_at TIMESTAMP, last_at TIMESTAMP, missing STRING"
# The earliest time of each required signal: never more entries than there are signals.
STATE = "signals ARRAY<STRING>, micros ARRAY<BIGINT>, reported BOOLEAN"


def _micros(at: pd.Timestamp) -> int:
    return pd.Timestamp(at).value // 1_000


def _completion(required: Sequence[str], timeout_seconds: int) -> Callable[..., Iterator[pd.DataFrame]]:
    names = sorted(required)
    limit = timeout_seconds * 1_000_000

    def in_time(known: dict[str, int]) -> dict[str, int]:
        deadline = min(known.values()) + limit
        return {s: at for s, at in known.items() if at <= deadline}

    def report(case_id: str, status: str, known: dict[str, int]) -> pd.DataFrame:
        there = in_time(known)
        return pd.DataFrame(
            {
                "case_id": [case_id],
                "status": [status],
                "first_at": [pd.Timestamp(min(there.values()), unit="us")],
                "last_at": [pd.Timestamp(max(there.values()), unit="us")],
                "missing": [",".join(s for s in names if s not in there)],
            }
        )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        signals, micros, reported = state.get if state.exists else ([], [], False)
        known = dict(zip(signals, micros))
        if state.hasTimedOut:
            state.remove()
            if known and not reported:
                yield report(key[0], "timed_out", known)
            return
        for frame in frames:
            wanted = frame[frame["signal"].isin(names)]
            for signal, at in wanted.groupby("signal")["at"].min().items():
                known[signal] = min(known.get(signal, _micros(at)), _micros(at))
        if not known:
            return
        if not reported and len(in_time(known)) == len(names):
            reported = True
            yield report(key[0], "complete", known)
        state.update((list(known), list(known.values()), reported))
        deadline = (min(known.values()) + limit) // 1_000
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs()) + 1)

    return step


def _earliest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.groupby(["case_id", "signal"], as_index=False)["at"].min()


def complete_cases(stream: DataFrame, required: Sequence[str], timeout_seconds: int, delay: str) -> DataFrame:
    """One row per case (case_id, signal, at in; case_id, status, first_at, last_at, missing out).

    `complete` as soon as every required signal has come within the timeout of the first one, otherwise `timed_out`
    when the watermark has passed that limit; a case is forgotten then. A signal that comes after the limit but before
    the case is forgotten belongs to the case that has run out of time and does not open another. Rows are folded to the earliest per case and
    signal in each batch before the shuffle, so a case with very many rows sends few of them.
    """
    rows = stream.selectExpr("CAST(case_id AS STRING) AS case_id", "signal", "at").where(
        F.col("case_id").isNotNull() & F.col("signal").isin(*required) & F.col("at").isNotNull()
    )
    folded = rows.mapInPandas(_earliest, "case_id STRING, signal STRING, at TIMESTAMP")
    return (
        folded.withWatermark("at", delay)
        .groupBy("case_id")
        .applyInPandasWithState(
            _completion(required, timeout_seconds), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )
