"""Probabilistic linkage against all pairs and a plain EM."""

from __future__ import annotations

import collections
import math
import random

import pytest

from idscreen.operators import linkage

FIELDS = ["name", "born", "city"]
SCHEMA = "id bigint, zone string, name string, born int, city string, extra string"


def _sides(n=120):
    rng = random.Random(6)
    left, right = [], []
    for k in range(n):
        row = [rng.choice("xy"), f"n{rng.randint(0, 40)}", rng.randint(1950, 1965), rng.choice(["A", "B", "C"])]
        left.append((k, *row, "l"))
        if rng.random() < 0.7:
            row[1 + rng.randrange(3)] = rng.choice([None, "n1", 1955, "A"]) if rng.random() < 0.3 else row[1]
            row[2] = row[2] if isinstance(row[2], int) else 1950
            right.append((1_000 + k, row[0], *[None if v is None else str(v) if i != 1 else v for i, v in enumerate(row[1:])], "r"))
    return left + [(900, "x", None, None, None, "l")], right + [(1_900, "x", None, None, None, "r"), right[0], right[0]]


def _pairs(left, right, block):
    for a in left:
        for b in right:
            if not block or a[1] == b[1]:
                pattern = sum(1 << k for k in range(3) if a[2 + k] is not None and a[2 + k] == b[2 + k])
                yield a[0], b[0], pattern


def _plain_em(patterns, rounds=200, share=1e-3):
    total = sum(patterns.values())
    m = [0.9] * 3
    u = [sum(c for p, c in patterns.items() if p >> k & 1) / total for k in range(3)]
    for _ in range(rounds):
        same = {}
        for p in patterns:
            a, b = share, 1 - share
            for k in range(3):
                a *= m[k] if p >> k & 1 else 1 - m[k]
                b *= u[k] if p >> k & 1 else 1 - u[k]
            same[p] = patterns[p] * a / (a + b)
        s = sum(same.values())
        share = s / total
        m = [sum(v for p, v in same.items() if p >> k & 1) / s for k in range(3)]
        u = [sum(patterns[p] - v for p, v in same.items() if p >> k & 1) / (total - s) for k in range(3)]
    return m, u, share


@pytest.mark.parametrize("block", [[], ["zone"]])
def test_patterns_weights_and_links(spark, block):
    left, right = _sides()
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    want = collections.Counter(p for _, _, p in _pairs(left, right, block))
    got = {r.pattern: int(r.pairs) for r in linkage.agreement_patterns(a, b, FIELDS, block).collect()}
    assert got == {p: want.get(p, 0) for p in range(8)}
    weights = linkage.weights_of(a, b, FIELDS, block, tolerance=0.0)
    m, u, share = _plain_em({p: c for p, c in want.items()})
    assert weights.m == pytest.approx(m, abs=1e-6) and weights.u == pytest.approx(u, abs=1e-6) and weights.share == pytest.approx(share, rel=1e-6)
    by_hand = math.log2(m[0] / u[0]) + math.log2((1 - m[1]) / (1 - u[1])) + math.log2(m[2] / u[2])
    assert weights.of(0b101) == pytest.approx(by_hand, abs=1e-4)
    for least in sorted({weights.of(p) for p in range(1, 8) if weights.of(p) > weights.of(0)}):
        links = linkage.linked_records(a, b, "id", "id", weights, least, block).collect()
        expected = sorted((x, y, p, round(weights.of(p), 6)) for x, y, p in _pairs(left, right, block) if weights.of(p) >= least)
        assert sorted(map(tuple, links)) == expected


def test_hot_values_make_no_pairs_while_learning(spark):
    rows = [(k, "x", "same", 1_990, f"c{k}", "") for k in range(30_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.pattern: int(r.pairs) for r in linkage.agreement_patterns(frame, frame, FIELDS).collect()}
    assert got[0b011] == 30_000**2 - 30_000 and got[0b111] == 30_000 and sum(got.values()) == 30_000**2


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert {int(r.pairs) for r in linkage.agreement_patterns(none, none, FIELDS).collect()} == {0}
    weights = linkage.weights_of(none, none, FIELDS)
    assert linkage.linked_records(none, none, "id", "id", weights, 1.0).count() == 0
    assert linkage.linked_records(none, none, "id", "id", weights, 1e9).columns == ["left_id", "right_id", "pattern", "weight"]
    with pytest.raises(ValueError):
        linkage.linked_records(none, none, "id", "id", weights, -1e9)
