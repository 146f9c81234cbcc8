"""The investigation trail: order, sessions, digests and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idscreen.functions import digest as dg
from idscreen.functions.ordering import HOT_ROWS, add_ordered, in_order, mark_chunks, micros

# Rows chained in one array; also how many digests a digest of the next level covers.
SEGMENT = 1_000
# Levels of digests: SEGMENT ** LEVELS rows per case.
LEVELS = 4


def case_timeline(
    events: DataFrame,
    case: str,
    ts: str,
    event_id: str,
    state: str,
    chunk_seconds: int = 86_400,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds place, previous and next state, first and last state of the case, seconds since the event before."""
    ordered = in_order(
        events.select(case, ts, event_id, state),
        [case],
        [ts, event_id],
        micros(ts),
        chunk_seconds * 1e6,
        number="place",
        previous={"previous_state": state, "_before": ts},
        following={"next_state": state},
        first={"first_state": state},
        last={"last_state": state},
        hot_rows=hot_rows,
    )
    elapsed = F.round((micros(ts) - micros("_before")) / 1e6, 6)
    return ordered.withColumn("elapsed_seconds", elapsed).drop("_before")


def sessions(
    events: DataFrame,
    case: str,
    ts: str,
    event_id: str,
    gap_seconds: int,
    chunk_seconds: int = 86_400,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Runs of a case's events with no gap above `gap_seconds`: (case, session_start, session_end, events)."""
    order = [ts, event_id]
    rows = mark_chunks(events.select(case, ts, event_id), [case], micros(ts), chunk_seconds * 1e6, hot_rows)
    back = add_ordered(rows, order, previous={"_before": ts})
    opens = F.col("_before").isNull() | (micros(ts) - micros("_before") > F.lit(gap_seconds * 1_000_000))
    placed = add_ordered(
        back.withColumn("_opened", F.when(opens, F.col(ts))), order, last_seen={"session_start": "_opened"}
    )
    return placed.groupBy(case, "session_start").agg(
        F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events")
    ).select(case, "session_start", "session_end", "events")


def _folded(rows: DataFrame, case: str) -> DataFrame:
    """One chain per (case, _segment) over rows (case, _segment, _place, _text, _rows)."""
    chained = F.array_sort(F.collect_list(F.struct("_place", "_text")))
    return rows.groupBy(case, "_segment").agg(
        dg.chain(F.transform(chained, lambda r: r["_text"])).alias("_text"), F.sum("_rows").alias("_rows")
    )


def trail_segments(
    events: DataFrame, case: str, order: str, columns: Sequence[str] | None = None, segment: int = SEGMENT
) -> DataFrame:
    """(case, segment_no, digest, rows): hash chain over each `segment` consecutive values of `order`.

    `order` is a whole number that is unique within a case, as a trail's sequence number is, so no array is longer
    than `segment`. Rows are hashed where they are read; only their digests are shuffled.
    """
    fields = list(columns or events.columns)
    rows = events.select(
        case,
        F.floor(F.col(order) / segment).alias("_segment"),
        F.col(order).alias("_place"),
        F.sha2(dg.row_text(fields), 256).alias("_text"),
        F.lit(1).cast("bigint").alias("_rows"),
    )
    return _folded(rows, case).select(
        case,
        F.col("_segment").cast("bigint").alias("segment_no"),
        F.col("_text").alias("digest"),
        F.col("_rows").alias("rows"),
    )


def trail_digest(
    events: DataFrame, case: str, order: str, columns: Sequence[str] | None = None, segment: int = SEGMENT
) -> DataFrame:
    """(case, digest, rows): segment digests chained again, `segment` of them at a time, up to one per case.

    A case of any length is spread over many groups; only its last levels come together.
    """
    level = trail_segments(events, case, order, columns, segment).select(
        case, F.col("segment_no").alias("_place"), F.col("digest").alias("_text"), F.col("rows").alias("_rows")
    )
    for _ in range(LEVELS - 2):
        level = _folded(level.withColumn("_segment", F.floor(F.col("_place") / segment)), case).select(
            case, F.col("_segment").alias("_place"), "_text", "_rows"
        )
    top = _folded(level.withColumn("_segment", F.lit(0)), case)
    return top.select(case, F.col("_text").alias("digest"), F.col("_rows").alias("rows"))


def trail_verify(
    events: DataFrame,
    digests: DataFrame,
    case: str,
    order: str,
    columns: Sequence[str] | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """Recomputed digests against stored ones: status same, changed, missing (gone) or extra (not stored)."""
    now = trail_digest(events, case, order, columns, segment).select(
        case, F.col("digest").alias("_now"), F.col("rows").alias("rows_now")
    )
    then = digests.select(case, F.col("digest").alias("_then"), F.col("rows").alias("rows_then"))
    status = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("_then").isNull(), "extra")
        .when((F.col("_now") == F.col("_then")) & (F.col("rows_now") == F.col("rows_then")), "same")
        .otherwise("changed")
    )
    return now.join(then, case, "full_outer").select(case, status.alias("status"), "rows_then", "rows_now")


def trail_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added and removed, with how many of each.

    Counted over row digests in one aggregation; only rows whose counts differ are then looked up, so two trails that
    are mostly equal shuffle little more than their digests.
    """
    columns = old.columns
    digest = F.sha2(dg.row_text(columns), 256)
    both = old.withColumn("_side", F.lit(-1)).unionByName(new.select(*columns).withColumn("_side", F.lit(1)))
    both = both.withColumn("_row", digest)
    differing = both.groupBy("_row").agg(F.sum("_side").alias("_net")).where("_net <> 0")
    found = both.drop("_side").join(differing, "_row").dropDuplicates(["_row"])
    return found.select(
        *columns,
        F.when(F.col("_net") > 0, "added").otherwise("removed").alias("change"),
        F.abs("_net").alias("n"),
    )
