"""Checks on the fields read from documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idscreen.functions import text


def unpivot_fields(records: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per record and field: (ids, field, value), value as a string."""
    as_text = records.select(*ids, *[F.col(f).cast("string").alias(f) for f in fields])
    return as_text.unpivot(list(ids), list(fields), "field", "value")


def normalize_fields(fields: DataFrame, date_formats: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Clean `value`; fields named in `date_formats` become ISO dates, or null when no format fits."""
    value: Column = text.clean(F.col("value"))
    for field, formats in (date_formats or {}).items():
        trimmed = F.trim(F.regexp_replace("value", text.BLANKS, " "))
        value = F.when(F.col("field") == field, text.iso_date(trimmed, formats)).otherwise(value)
    return fields.withColumn("value", value)


def validate_format(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Judge each field that has a rule for its document type: `status` is pass, fail or missing.

    `rules`: doc_type, field, pattern, required. A pattern is looked for anywhere; anchor it to cover the value.
    """
    missing = F.col("value").isNull()
    status = (
        F.when(missing & F.col("required"), "missing")
        .when(missing, "pass")
        .when(F.regexp_like("value", F.col("pattern")), "pass")
        .otherwise("fail")
    )
    judged = fields.join(rules.select("doc_type", "field", "pattern", "required"), ["doc_type", "field"])
    return judged.select(*fields.columns, status.alias("status"))


def validate_check_digit(
    df: DataFrame, col: str, weights: Sequence[int], modulus: int, alphabet: str = text.ALPHABET
) -> DataFrame:
    """Add `check_ok` for a weighted check digit in the last place."""
    return df.withColumn("check_ok", text.check_digit_ok(F.col(col), weights, modulus, alphabet))


def validate_luhn(df: DataFrame, col: str) -> DataFrame:
    """Add `check_ok` for a Luhn number."""
    return df.withColumn("check_ok", F.call_function("luhn_check", F.col(col)))


def validate_order(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """The rows in which `later` lies before `earlier`."""
    return df.where(F.col(later) < F.col(earlier))


# Pairs that one segment may bring together before its values are compared by what is left after deletions.
HOT_PAIRS = 1_000_000


def field_conflicts(fields: DataFrame, entity_keys: Sequence[str], field: str) -> DataFrame:
    """Every value of `field` for entities that have more than one: (keys, field, readings, n_values).

    One row per value, so an entity with very many values needs no array.
    """
    keys = list(entity_keys)
    values = fields.where(F.col(field).isNotNull()).groupBy(*keys, field).agg(F.count(F.lit(1)).alias("readings"))
    several = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = values.alias("v").join(several.alias("s"), same)
    return joined.select(*[F.col(f"v.{k}") for k in keys], f"v.{field}", "v.readings", "s.n_values")


def fuzzy_matches(
    left: DataFrame, right: DataFrame | None, block: Sequence[str], col: str, max_dist: int, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """Pairs of values within `max_dist` edits inside a block, with the number of rows that hold each.

    With `right` None, pairs inside `left`, each once with the smaller value first. Values are folded first.

    A right value is cut into max_dist + 1 segments; a left value within `max_dist` edits holds one of them unchanged, and
    little moved (Pass-Join, Li et al. 2011). So candidates share a segment, and a value has a number of probes that does not
    grow with its length. Segments that would bring more than `hot_pairs` pairs together, such as a beginning common to all values, are
    left out; values that meet in one, and values too short to be cut, share instead what is left after deleting up to
    `max_dist` characters from each.
    """
    keys = list(block)

    def folded(df: DataFrame, side: str) -> DataFrame:
        named = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias(f"{side}_value"))
        return named.agg(F.count(F.lit(1)).alias(f"{side}_rows"))

    def variants(values: DataFrame, side: str) -> DataFrame:
        return values.withColumn("_variant", F.explode(text.deletions(F.col(f"{side}_value"), max_dist)))

    a = folded(left, "left")
    b = folded(left if right is None else right, "right")
    probes, segments = text.segment_probes(a, "left_value", max_dist), text.segments(b, "right_value", max_dist)
    found_by = [*keys, "_length", "_number", "_segment"]
    count = F.count(F.lit(1))
    met = probes.groupBy(*found_by).agg(count.alias("_l")).join(segments.groupBy(*found_by).agg(count.alias("_r")), found_by)
    hot = met.where(F.col("_l").cast("double") * F.col("_r") > hot_pairs).select(*found_by)
    pairs = [*keys, "left_value", "right_value", "left_rows", "right_rows"]
    near = probes.join(hot, found_by, "left_anti").join(segments, found_by).select(*pairs)

    def apart(values: DataFrame, cut: DataFrame, side: str, longest: int) -> DataFrame:
        """Values that meet in a hot segment, and short ones."""
        in_hot = cut.join(hot, found_by, "left_semi").select(*keys, f"{side}_value", f"{side}_rows")
        return in_hot.unionByName(values.where(F.char_length(f"{side}_value") <= longest)).distinct()

    lefts = variants(apart(a, probes, "left", 2 * max_dist), "left")
    rights = variants(apart(b, segments, "right", max_dist), "right")
    close = F.col("distance") >= 0
    if right is None:
        close = close & (F.col("left_value") < F.col("right_value"))
    return (
        near.unionByName(lefts.join(rights, [*keys, "_variant"]).select(*pairs))
        .withColumn("distance", F.levenshtein("left_value", "right_value", max_dist).cast("bigint"))
        .where(close)
        .select(*keys, "left_value", "right_value", "left_rows", "right_rows", "distance")
        .distinct()
    )
