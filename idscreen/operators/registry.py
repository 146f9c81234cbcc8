"""Records against registries and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idscreen.functions.ordering import HOT_ROWS, in_order, micros


def registry_check(
    records: DataFrame, registry: DataFrame, keys: Sequence[str], compare: Sequence[str]
) -> DataFrame:
    """Add `status` (found, mismatch, not_found) and `differing`, the compared fields that are not the same.

    The registry holds each key once.
    """
    entries = registry.select(*keys, *[F.col(c).alias(f"_reg_{c}") for c in compare], F.lit(True).alias("_listed"))
    joined = records.join(entries, list(keys), "left")
    differing = F.array_compact(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_reg_{c}")), F.lit(c)) for c in compare])
    )
    status = (
        F.when(F.col("_listed").isNull(), "not_found").when(F.size(differing) > 0, "mismatch").otherwise("found")
    )
    return joined.select(
        *records.columns,
        status.alias("status"),
        F.when(F.col("_listed"), differing).otherwise(F.array().cast("array<string>")).alias("differing"),
    )


def not_in_registry(records: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.join(registry.select(*keys), list(keys), "left_anti")


def listed(records: DataFrame, listing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records whose keys are on the list. No broadcast is forced: Spark decides from the size it finds."""
    return records.join(listing.select(*keys), list(keys), "left_semi")


def registry_as_of(
    records: DataFrame,
    versions: DataFrame,
    key: str,
    ts: str,
    *,
    record_order: str,
    version_ts: str,
    version_order: str,
    values: Sequence[str],
    valid_to: str | None = None,
    chunk_seconds: int = 86_400,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each record with the values of the latest version that started at or before its time, null if none.

    `record_order` and `version_order` make rows with one key and time unique. With `valid_to`, a version that
    had ended by then counts as none. Both inputs go through one shuffle as a single ordered sequence, so a key
    with many versions never meets its records pair by pair.
    """
    kept = [*values, valid_to] if valid_to else list(values)
    record = F.struct(*records.columns)
    version = F.struct(F.col(version_ts).alias("_from"), *kept)
    version_type = versions.select(version.alias("v")).schema["v"].dataType
    record_type = records.select(record.alias("r")).schema["r"].dataType
    stream = records.select(
        F.col(key).alias("_k"),
        F.col(ts).alias("_ts"),
        F.lit(1).alias("_kind"),
        F.col(record_order).alias("_record_tie"),
        F.lit(None).cast(versions.schema[version_order].dataType).alias("_version_tie"),
        record.alias("_record"),
        F.lit(None).cast(version_type).alias("_version"),
    ).unionByName(
        versions.where(F.col(key).isNotNull() & F.col(version_ts).isNotNull()).select(
            F.col(key).alias("_k"),
            F.col(version_ts).alias("_ts"),
            F.lit(0).alias("_kind"),
            F.lit(None).cast(records.schema[record_order].dataType).alias("_record_tie"),
            F.col(version_order).alias("_version_tie"),
            F.lit(None).cast(record_type).alias("_record"),
            version.alias("_version"),
        )
    )
    seen = in_order(
        stream,
        ["_k"],
        ["_ts", "_kind", "_version_tie", "_record_tie"],
        micros("_ts"),
        chunk_seconds * 1e6,
        last_seen={"_found": "_version"},
        hot_rows=hot_rows,
    ).where("_kind = 1")
    usable = F.lit(True)
    if valid_to:
        ended = F.col(f"_found.{valid_to}")
        usable = ended.isNull() | (ended > F.col("_ts"))
    return seen.select(
        "_record.*",
        F.when(usable, F.col("_found._from")).alias("version_from"),
        *[F.when(usable, F.col(f"_found.{v}")).alias(v) for v in values],
    )
