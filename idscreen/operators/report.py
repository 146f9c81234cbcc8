"""What checkpoints see: counts, rates, times and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idscreen.functions.ordering import HOT_ROWS, in_order, micros
from idscreen.functions.quantiles import percentiles

UNITS = ("hour", "day", "week", "month", "quarter", "year")


def checkpoint_summary(
    cases: DataFrame,
    dims: Sequence[str],
    mode: str = "rollup",
    flag: str | None = None,
    sets: Sequence[Sequence[str]] = (),
    count: str | None = None,
) -> DataFrame:
    """Cases (and with `flag` flagged cases and their rate) per combination of `dims` with subtotals.

    `mode` is rollup, cube or sets. `level` is the grouping id: one bit per dimension, set where it is summed up.
    Cases are folded to one row per combination before the subtotals multiply rows. `count` names a column with the
    number of cases a row stands for, when they are folded already.
    """
    each = F.col(count) if count else F.lit(1).cast("bigint")
    flagged = F.sum(F.when(F.col(flag), each).otherwise(0)) if flag else F.lit(0)
    folded = cases.groupBy(*dims).agg(F.sum(each).alias("_cases"), flagged.alias("_flagged"))
    if mode == "rollup":
        grouped = folded.rollup(*dims)
    elif mode == "cube":
        grouped = folded.cube(*dims)
    elif mode == "sets":
        grouped = folded.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims])
    else:
        raise ValueError("mode must be rollup, cube or sets")
    out = [F.grouping_id().cast("bigint").alias("level"), F.sum("_cases").alias("cases")]
    if flag:
        out += [
            F.sum("_flagged").alias("flagged"),
            F.round(F.sum("_flagged") / F.sum("_cases"), 6).alias("flagged_rate"),
        ]
    return grouped.agg(*out)


def checkpoint_deviation(cases: DataFrame, checkpoint: str, flag: str) -> DataFrame:
    """Each checkpoint's flagged rate against the rate over all, as a z-value."""
    hit = F.sum(F.when(F.col(flag), 1).otherwise(0))
    per = cases.groupBy(checkpoint).agg(F.count(F.lit(1)).alias("cases"), hit.alias("flagged"))
    overall = per.agg((F.sum("flagged") / F.sum("cases")).alias("_overall")).scalar()
    rated = per.withColumn("_rate", F.col("flagged") / F.col("cases")).withColumn("_overall", overall)
    spread = F.sqrt(F.col("_overall") * (1 - F.col("_overall")) / F.col("cases"))
    return rated.select(
        checkpoint,
        "cases",
        "flagged",
        F.round("_rate", 6).alias("rate"),
        F.round("_overall", 6).alias("overall_rate"),
        F.round((F.col("_rate") - F.col("_overall")) / F.nullif(spread, F.lit(0.0)), 6).alias("z"),
    )


def stage_times(
    events: DataFrame,
    case: str,
    ts: str,
    stage: str,
    event_id: str,
    method: str = "exact",
    chunk_seconds: int = 86_400,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Seconds between consecutive events of a case, per pair of stages: steps, p50, p95, max.

    `exact` interpolates over all values; `approx` uses a bounded summary per pair of stages.
    """
    ordered = in_order(
        events.select(case, ts, stage, event_id),
        [case],
        [ts, event_id],
        micros(ts),
        chunk_seconds * 1e6,
        previous={"from_stage": stage, "_from": ts},
        hot_rows=hot_rows,
    ).where("_from IS NOT NULL")
    steps = ordered.select(
        "from_stage", F.col(stage).alias("to_stage"), ((micros(ts) - micros("_from")) / 1e6).alias("_seconds")
    )
    pair = ["from_stage", "to_stage"]
    points = {"p50_seconds": 0.5, "p95_seconds": 0.95}
    totals = [F.count(F.lit(1)).alias("steps"), F.round(F.max("_seconds"), 6).alias("max_seconds")]
    if method == "approx":
        near = [F.round(F.percentile_approx("_seconds", p, 10_000), 6).alias(n) for n, p in points.items()]
        return steps.groupBy(*pair).agg(*totals, *near)
    exact = percentiles(steps, pair, "_seconds", points)
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"q.{c}")) for c in pair]
    joined = steps.groupBy(*pair).agg(*totals).alias("t").join(exact.alias("q"), same)
    return joined.select(
        *[F.col(f"t.{c}") for c in pair],
        "t.steps",
        *[F.round(F.col(f"q.{n}"), 6).alias(n) for n in points],
        "t.max_seconds",
    )


def volume_trend(
    events: DataFrame, ts: str, unit: str = "day", frame: int = 7, by: Sequence[str] = ()
) -> DataFrame:
    """Events per period, running total, and mean over the last `frame` periods that have events.

    Windows run over periods, not events: one row per hour at the finest.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    period: Column = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    counts = events.groupBy(*by, period.alias("period")).agg(F.count(F.lit(1)).alias("events"))
    along = Window.partitionBy(*by).orderBy("period")
    recent = along.rowsBetween(-(frame - 1), Window.currentRow)
    return counts.select(
        *by,
        "period",
        "events",
        F.sum("events").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running_total"),
        F.round(F.avg("events").over(recent), 6).alias("moving_mean"),
    )
