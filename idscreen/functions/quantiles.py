"""Exact percentiles and ranks without sorting a whole group in one task.

Equal values are first folded into counts. Values are then spread over buckets that never fall as the value
rises; running totals are taken over the buckets (a few hundred thousand at most, whatever the data) and only
then inside each bucket. Buckets follow the logarithm of the value, so values of a narrow relative range fall into
few of them, and each is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 64 buckets for each doubling of the absolute value.
STEPS = 64
# Shifts log2 of the smallest positive double above zero.
SHIFT = 1_100


def value_bucket(value: Column) -> Column:
    size = F.floor((F.log2(F.abs(value)) + SHIFT) * STEPS)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _bucket_totals(counts: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per key and bucket, with the sums of earlier buckets and of the whole key."""
    sums = counts.groupBy("_key", "_bucket").agg(*[F.sum(m).alias(f"_b_{m}") for m in measures])
    along = Window.partitionBy("_key").orderBy("_bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sums.select(
        "_key",
        "_bucket",
        *[F.col(f"_b_{m}") for m in measures],
        *[F.coalesce(F.sum(f"_b_{m}").over(earlier), F.lit(0)).alias(f"_e_{m}") for m in measures],
        *[F.sum(f"_b_{m}").over(whole).alias(f"_t_{m}") for m in measures],
    )


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(1).alias("one"))


def cumulative(counts: DataFrame, value: str, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add to rows unique by (keys, value): `below_<m>`, the sum of m over smaller values, and `total_<m>`."""
    marked = counts.withColumn("_key", _key(keys)).withColumn("_bucket", value_bucket(F.col(value)))
    inside = Window.partitionBy("_key", "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return marked.join(_bucket_totals(marked, measures), ["_key", "_bucket"]).select(
        *counts.columns,
        *[(F.col(f"_e_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"below_{m}") for m in measures],
        *[F.col(f"_t_{m}").alias(f"total_{m}") for m in measures],
    )


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], count: str | None = None
) -> DataFrame:
    """Interpolated percentiles per key: `points` is new column -> fraction. Null values are left out.

    `count` names a column of row counts when `df` is already folded.
    """
    weight = F.sum(count) if count else F.count(F.lit(1))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(_key(keys).alias("_key"), F.col(value).cast("double").alias("_value"))
        .agg(weight.alias("_n"))
        .withColumn("_bucket", value_bucket(F.col("_value")))
    )
    totals = _bucket_totals(counts, ["_n"])
    spot = {name: (F.col("_t__n") - 1) * F.lit(p) for name, p in points.items()}
    needed = F.lit(False)
    for at in spot.values():
        for rank in (F.floor(at), F.ceil(at)):
            needed = needed | ((rank >= F.col("_e__n")) & (rank < F.col("_e__n") + F.col("_b__n")))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(totals.where(needed), ["_key", "_bucket"]).withColumn(
        "_from", F.col("_e__n") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    parts: list[Column] = []
    for name, at in spot.items():
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (rank >= F.col("_from")) & (rank < F.col("_from") + F.col("_n"))
            parts.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{side}_{name}"))
        parts.append(F.max(at - F.floor(at)).alias(f"_part_{name}"))
    found = ranked.groupBy("_key").agg(*parts)
    return found.select(
        *[F.col("_key")[k].alias(k) for k in keys],
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in points
        ],
    )
