"""Row order inside a key, when one key may hold a large part of all rows.

A plain window sorts each key in one task. Here a key with more than `hot_rows` rows is cut into chunks
along its first order column; every chunk is a window of its own, and what a row needs from the chunks
before or after it (last values seen, row counts) comes from a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
# A key is hot only if it also holds more than this share of all rows, so there are at most 1 / HOT_SHARE
# hot keys and the table of them may be broadcast.
HOT_SHARE = 1e-5


def hot_keys(df: DataFrame, hot_rows: int) -> DataFrame:
    """`_key` of each key above both limits: at most 1 / HOT_SHARE rows."""
    counts = df.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    limit = F.greatest(F.lit(float(hot_rows)), total.scalar() * F.lit(HOT_SHARE))
    return counts.where(F.col("_n") > limit).select("_key", F.lit(True).alias("_hot"))


LOWEST = -(2**62)
MARKS = ("_key", "_hot", "_chunk")


def mark_chunks(df: DataFrame, keys: Sequence[str], position: Column, width: float, hot_rows: int) -> DataFrame:
    """Add `_key`, `_hot` and `_chunk`: the part of `position` for a hot key, null for an ordinary one.

    Rows without a position come first in order, so they form the lowest chunk.
    """
    keyed = df.withColumn("_key", F.struct(*keys))
    marked = keyed.join(F.broadcast(hot_keys(keyed, hot_rows)), "_key", "left")
    part = F.coalesce(F.floor(position / F.lit(width)).cast("bigint"), F.lit(LOWEST).cast("bigint"))
    return marked.withColumn("_chunk", F.when(F.col("_hot"), part))


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: Column,
    width: float,
    *,
    hot_rows: int = HOT_ROWS,
    **wanted: str | Mapping[str, str],
) -> DataFrame:
    """Add order-dependent columns per key; `wanted` as in `add_ordered`.

    `position` is a number that never falls along `order`; hot keys are cut every `width` of it.
    """
    return add_ordered(mark_chunks(df, keys, position, width, hot_rows), order, **wanted).drop(*MARKS)


def add_ordered(
    chunked: DataFrame,
    order: Sequence[str],
    *,
    number: str | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    last_seen: Mapping[str, str] | None = None,
    first: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
) -> DataFrame:
    """Order-dependent columns for rows marked with their chunk; the marks stay, and with them the partitioning.

    `order` must be total inside a key. Each mapping is new column -> source column: `previous` and `following` read
    the neighbouring row, `last_seen` the latest non-null value up to this row, `first` and `last` the ends of the
    key. `number` names a row number from 1.
    """
    previous, following, last_seen = dict(previous or {}), dict(following or {}), dict(last_seen or {})
    first, last = dict(first or {}), dict(last or {})
    columns = chunked.columns

    group = Window.partitionBy("_key", "_chunk")
    ordered = group.orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local: dict[str, Column] = {}
    if number:
        local["_number"] = F.row_number().over(ordered)
    for out, col in previous.items():
        local[f"_p_{out}"] = F.lag(F.struct(col)).over(ordered)
    for out, col in following.items():
        local[f"_f_{out}"] = F.lead(F.struct(col)).over(ordered)
    for out, col in last_seen.items():
        local[f"_s_{out}"] = F.last(F.col(col), ignorenulls=True).over(before)
    for out, col in first.items():
        local[f"_a_{out}"] = F.first(F.struct(col)).over(before)
    for out, col in last.items():
        local[f"_z_{out}"] = F.last(F.struct(col)).over(whole)
    rows = chunked.withColumns(local)

    place = F.struct(*order)
    summary = [F.count(F.lit(1)).alias("_n")]
    for out, col in {**previous, **last}.items():
        summary.append(F.max_by(F.struct(col), place).alias(f"_end_{out}"))
    for out, col in {**following, **first}.items():
        summary.append(F.min_by(F.struct(col), place).alias(f"_start_{out}"))
    for out, col in last_seen.items():
        summary.append(F.max_by(col, F.when(F.col(col).isNotNull(), place)).alias(f"_seen_{out}"))
    # A window's partition column: the filter moves below earlier passes, down to the join with the hot keys.
    chunks = chunked.where("_chunk IS NOT NULL").groupBy("_key", "_chunk").agg(*summary)

    along = Window.partitionBy("_key").orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before")]
    for out in previous:
        carried.append(F.lag(f"_end_{out}").over(along).alias(f"_cp_{out}"))
    for out in following:
        carried.append(F.lead(f"_start_{out}").over(along).alias(f"_cf_{out}"))
    for out in last_seen:
        carried.append(F.last(f"_seen_{out}", ignorenulls=True).over(earlier).alias(f"_cs_{out}"))
    for out in first:
        carried.append(F.first(f"_start_{out}").over(everything).alias(f"_ca_{out}"))
    for out in last:
        carried.append(F.last(f"_end_{out}").over(everything).alias(f"_cz_{out}"))
    joined = rows.join(chunks.select("_key", "_chunk", *carried), ["_key", "_chunk"], "left")

    result: dict[str, Column] = {}
    if number:
        result[number] = (F.col("_number") + F.coalesce(F.col("_rows_before"), F.lit(0))).cast("bigint")
    for out, col in previous.items():
        result[out] = F.coalesce(f"_p_{out}", f"_cp_{out}")[col]
    for out, col in following.items():
        result[out] = F.coalesce(f"_f_{out}", f"_cf_{out}")[col]
    for out in last_seen:
        result[out] = F.coalesce(f"_s_{out}", f"_cs_{out}")
    for out, col in first.items():
        result[out] = F.coalesce(f"_ca_{out}", f"_a_{out}")[col]
    for out, col in last.items():
        result[out] = F.coalesce(f"_cz_{out}", f"_z_{out}")[col]
    return joined.select(*columns, *[c.alias(name) for name, c in result.items()])


def micros(ts: str | Column) -> Column:
    """A timestamp with or without zone as microseconds since 1970; without a zone, the session's zone plays no part."""
    col = F.col(ts) if isinstance(ts, str) else ts
    since = col.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    plain = F.call_function("div", since, F.expr("INTERVAL '0.000001' SECOND"))
    # The type is known when the plan is made, so one branch remains.
    return F.when(F.typeof(col) == "timestamp_ntz", plain).otherwise(F.unix_micros(col.cast("timestamp")))
