"""Sketches stored by day and merged later: quantiles of a value, distinct persons, and persons two checkpoints share.

A day's rows are read once; any range of days is then answered from its sketches, whose size does not depend on the rows.
Quantiles are KLL sketches (Karnin, Lang & Liberty 2016), distinct counts theta sketches (Dasgupta et al. 2016), both of
Spark. A sketch is folded in every task before it is shuffled, so a group with most of the rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KLL_K = 400
LG_ENTRIES = 14


def rank_error(k: int = KLL_K) -> float:
    """By how much the share of rows up to an estimated quantile may miss the wanted one: three times the error expected for
    sketches of this size."""
    return 3 * 2.296 / k**0.9021


def count_error(lg_entries: int = LG_ENTRIES) -> float:
    """By which share an estimated number may miss the true one: four standard errors."""
    return 4 / (1 << lg_entries) ** 0.5


def value_sketches(rows: DataFrame, by: Sequence[str], ts: str, value: str, k: int = KLL_K) -> DataFrame:
    """(by, day, sketch, n): a sketch of every group and day. Nulls are not counted; a group without values has no row."""
    known = rows.where(F.col(value).isNotNull()).withColumn("day", F.col(ts).cast("date"))
    return known.groupBy(*by, "day").agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def merged_quantiles(sketches: DataFrame, by: Sequence[str], shares: Sequence[float], k: int = KLL_K) -> DataFrame:
    """(by, share, n, estimate) over all days of the given sketches."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("_all"), F.sum("n").alias("n"))
    asked = F.array(
        *[F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("_all", F.lit(float(s))).alias("estimate")) for s in shares]
    )
    return merged.select(*by, "n", F.inline(asked)).select(*by, "share", "n", "estimate")


def person_sketches(rows: DataFrame, by: Sequence[str], ts: str, person: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(by, day, sketch): who was seen in every group and day. A null person is nobody."""
    known = rows.where(F.col(person).isNotNull()).withColumn("day", F.col(ts).cast("date"))
    return known.groupBy(*by, "day").agg(F.theta_sketch_agg(F.col(person), lg_entries).alias("sketch"))


def distinct_persons(sketches: DataFrame, by: Sequence[str], lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(by, persons, sketch): about how many persons the groups saw over all days; the sketch is the union."""
    merged = sketches.groupBy(*by).agg(F.theta_union_agg("sketch", lg_entries).alias("sketch"))
    return merged.select(*by, F.theta_sketch_estimate("sketch").alias("persons"), "sketch")


def shared_persons(groups: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """(a, b, shared): about how many persons were seen in both groups of each wanted pair (a, b)."""
    first = groups.select(F.col(by).alias("a"), F.col("sketch").alias("_a"))
    second = groups.select(F.col(by).alias("b"), F.col("sketch").alias("_b"))
    met = pairs.select("a", "b").join(first, "a").join(second, "b")
    return met.select("a", "b", F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("shared"))
