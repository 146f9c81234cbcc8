"""Probabilistic linkage: records of two sources that are likely the same person, although fields differ.

How much a field's agreement tells is learned from the data by EM over agreement patterns (Fellegi & Sunter 1969; Winkler 1988).
No pair of records is made for that: how many pairs agree on a set of fields follows from how often each combination of
their values occurs on either side, and the pairs with exactly one pattern follow from those by inclusion and exclusion.
Pairs are made only where the weights can reach the wanted total.

A null never agrees with anything. Every pair of a left and a right record with equal block columns counts; without block
columns every pair does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FIELDS = 8


@dataclass(frozen=True)
class Weights:
    """Chance that a field agrees, for pairs of the same person (`m`) and of two persons (`u`), and the share of the former."""

    fields: tuple[str, ...]
    m: tuple[float, ...]
    u: tuple[float, ...]
    share: float

    def of(self, pattern: int) -> float:
        """Sum over the fields of log2 of how much likelier the agreement or difference is for the same person."""
        total = 0.0
        for k, (m, u) in enumerate(zip(self.m, self.u)):
            total += float(np.log2(m / u) if pattern >> k & 1 else np.log2((1 - m) / (1 - u)))
        return total


def _subsets(n: int) -> list[int]:
    return list(range(1 << n))


def _agreeing(df: DataFrame, block: Sequence[str], fields: Sequence[str], rows: str) -> DataFrame:
    """(block columns, _fields, _values, rows): how many records hold a combination of values, for every set of fields.

    Equal records are folded before they are repeated for the sets, so a value that many share is few rows.
    """
    folded = df.groupBy(*block, *fields).agg(F.count(F.lit(1)).alias(rows))
    sets = []
    for mask in _subsets(len(fields)):
        chosen = [f for k, f in enumerate(fields) if mask >> k & 1]
        known = F.lit(True)
        for f in chosen:
            known = known & F.col(f).isNotNull()
        values = F.to_json(F.struct(*[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(chosen)])) if chosen else F.lit("")
        sets.append(F.when(known, F.struct(F.lit(mask).alias("_fields"), values.alias("_values"))))
    repeated = folded.select(*block, rows, F.inline(F.array_compact(F.array(*sets))))
    return repeated.groupBy(*block, "_fields", "_values").agg(F.sum(rows).alias(rows))


def agreement_patterns(left: DataFrame, right: DataFrame, fields: Sequence[str], block: Sequence[str] = ()) -> DataFrame:
    """(pattern, pairs) for every pattern: the number of pairs that agree on just these fields; bit k stands for field k."""
    if not 1 <= len(fields) <= MAX_FIELDS:
        raise ValueError(f"from 1 to {MAX_FIELDS} fields")
    a, b = _agreeing(left, block, fields, "_l"), _agreeing(right, block, fields, "_r")
    product = F.col("_l").cast("decimal(19,0)") * F.col("_r").cast("decimal(19,0)")
    same = [*block, "_fields", "_values"]
    at_least = a.join(b, same).groupBy("_fields").agg(F.sum(product).alias("_pairs"))
    # exactly a pattern: those that agree on at least its fields, less and more of those that agree on more
    signs = []
    for mask in _subsets(len(fields)):
        for pattern in _subsets(len(fields)):
            if pattern & mask == pattern:
                signs.append((mask, pattern, -1 if (mask ^ pattern).bit_count() % 2 else 1))
    spark = left.sparkSession
    table = spark.createDataFrame(signs, "_fields int, pattern int, _sign int")
    counted = table.join(at_least, "_fields", "left").groupBy("pattern")
    return counted.agg(F.coalesce(F.sum(F.col("_sign") * F.col("_pairs")), F.lit(0)).cast("decimal(38,0)").alias("pairs"))


def learn_weights(patterns: Mapping[int, float], fields: Sequence[str], rounds: int = 200, share: float = 1e-3, tolerance: float = 1e-10) -> Weights:
    """EM over counted patterns, of which there are at most 2 ** fields. Fields are taken as independent within either
    kind of pair. It starts from fields that agree in nine of ten pairs of the same person and as often as counted in others.
    """
    n = len(fields)
    masks = np.array(sorted(patterns))
    counts = np.array([float(patterns[k]) for k in sorted(patterns)])
    agree = (masks[:, None] >> np.arange(n)) & 1
    total = counts.sum()
    low, high = 1e-9, 1 - 1e-9
    m = np.full(n, 0.9)
    u = np.clip((counts @ agree) / max(total, 1), low, high) if total else np.full(n, 0.1)
    for _ in range(rounds if total else 0):
        log_m = agree @ np.log(m) + (1 - agree) @ np.log1p(-m)
        log_u = agree @ np.log(u) + (1 - agree) @ np.log1p(-u)
        odds = np.log(share) - np.log1p(-share) + log_m - log_u
        same = counts / (1 + np.exp(np.clip(-odds, -700, 700)))
        other = counts - same
        before = np.r_[m, u, share]
        share = float(np.clip(same.sum() / total, low, high))
        m = np.clip(same @ agree / max(same.sum(), 1e-300), low, high)
        u = np.clip(other @ agree / max(other.sum(), 1e-300), low, high)
        if np.abs(np.r_[m, u, share] - before).max() < tolerance:
            break
    return Weights(tuple(fields), tuple(map(float, m)), tuple(map(float, u)), share)


def weights_of(left: DataFrame, right: DataFrame, fields: Sequence[str], block: Sequence[str] = (), **options: float) -> Weights:
    """Weights learned from two tables. The driver reads one row for each pattern."""
    rows = agreement_patterns(left, right, fields, block).collect()
    return learn_weights({r["pattern"]: float(r["pairs"]) for r in rows}, fields, **options)


def _least_sets(weights: Weights, least: float) -> list[int]:
    """The patterns that reach the wanted weight, without those that hold another one."""
    wanted = [p for p in _subsets(len(weights.fields)) if weights.of(p) >= least]
    # every wanted pattern contains one of these, and none of these contains another
    return [p for p in wanted if not any(q != p and q & p == q for q in wanted)]


def linked_records(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    weights: Weights,
    least: float,
    block: Sequence[str] = (),
) -> DataFrame:
    """(left_id, right_id, pattern, weight) for every pair whose weight is `least` or more, rounded to six places.

    Pairs are joined on the smallest sets of fields whose agreement reaches `least`. A threshold that a pair without any agreement
    reaches would mean every pair, and is refused.
    """
    fields = weights.fields
    sets = _least_sets(weights, least)
    if 0 in sets:
        raise ValueError("pairs that agree on nothing reach this weight")
    a = left.select(F.col(left_id).alias("left_id"), *block, *[F.col(f).alias(f"_a{k}") for k, f in enumerate(fields)])
    b = right.select(F.col(right_id).alias("right_id"), *block, *[F.col(f).alias(f"_b{k}") for k, f in enumerate(fields)])
    pattern = F.lit(0)
    for k in range(len(fields)):
        pattern = pattern + F.when(F.col(f"_a{k}") == F.col(f"_b{k}"), 1 << k).otherwise(0)
    wanted = [p for p in _subsets(len(fields)) if weights.of(p) >= least]
    value = F.coalesce(*[F.when(F.col("pattern") == p, F.lit(round(weights.of(p), 6))) for p in wanted], F.lit(None).cast("double"))
    found = None
    for number, mask in enumerate(sets):
        chosen = [k for k in range(len(fields)) if mask >> k & 1]
        x = a.withColumnsRenamed({f"_a{k}": f"_k{k}" for k in chosen})
        y = b.withColumnsRenamed({f"_b{k}": f"_k{k}" for k in chosen})
        met = x.join(y, [*block, *[f"_k{k}" for k in chosen]])
        met = met.withColumns({f"_a{k}": F.col(f"_k{k}") for k in chosen} | {f"_b{k}": F.col(f"_k{k}") for k in chosen})
        met = met.withColumn("pattern", pattern)
        # a pair comes out of the first set that it agrees on, and only there
        first = F.lit(True)
        for earlier in sets[:number]:
            first = first & (F.col("pattern").bitwiseAND(earlier) != earlier)
        met = met.where(first & F.col("pattern").isin(wanted)).select("left_id", "right_id", "pattern", value.alias("weight"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        nothing = "left_id {}, right_id {}, pattern int, weight double".format(*(d.schema[c].dataType.simpleString() for d, c in ((left, left_id), (right, right_id))))
        return left.sparkSession.createDataFrame([], nothing)
    return found
