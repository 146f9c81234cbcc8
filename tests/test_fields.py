from __future__ import annotations

import itertools
import random

import pytest

from idscreen.operators import fields


def lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_normalize_cleans_and_is_idempotent(spark):
    rows = [(1, "name", "  José \t  Müller "), (2, "name", "   "), (3, "dob", "31/12/1999"), (4, "dob", "2024-02-31"), (5, "dob", None)]
    long = spark.createDataFrame(rows, "id INT, field STRING, value STRING")
    once = fields.normalize_fields(long, {"dob": ["yyyy-MM-dd", "dd/MM/yyyy"]})
    got = {r["id"]: r["value"] for r in once.collect()}
    assert got == {1: "JOSE MULLER", 2: None, 3: "1999-12-31", 4: None, 5: None}
    twice = fields.normalize_fields(once, {"dob": ["yyyy-MM-dd", "dd/MM/yyyy"]})
    assert {r["id"]: r["value"] for r in twice.collect()} == got


def test_format_status(spark):
    long = spark.createDataFrame(
        [(1, "visa", "no", "A12"), (2, "visa", "no", "12"), (3, "visa", "no", None), (4, "visa", "note", None), (5, "pass", "no", "A1")],
        "id INT, doc_type STRING, field STRING, value STRING",
    )
    rules = spark.createDataFrame(
        [("visa", "no", "^[A-Z][0-9]+$", True), ("visa", "note", "x", False)],
        "doc_type STRING, field STRING, pattern STRING, required BOOLEAN",
    )
    got = {r["id"]: r["status"] for r in fields.validate_format(long, rules).collect()}
    assert got == {1: "pass", 2: "fail", 3: "missing", 4: "pass"}


def test_check_digits(spark):
    # 7-3-1 weights modulo 10, the worked example of the public standard for machine-readable travel documents.
    df = spark.createDataFrame([("L898902C36",), ("L898902C37",), ("7408122",), ("L8*8902C36",), ("6",), (None,)], "n STRING")
    got = [r["check_ok"] for r in fields.validate_check_digit(df, "n", [7, 3, 1], 10).collect()]
    assert got == [True, False, True, None, None, None]
    luhn = spark.createDataFrame([("79927398713",), ("79927398710",)], "n STRING")
    assert [r["check_ok"] for r in fields.validate_luhn(luhn, "n").collect()] == [True, False]


def test_order_ignores_nulls(spark):
    df = spark.createDataFrame([(1, "2020-01-02", "2020-01-01"), (2, "2020-01-01", "2020-01-01"), (3, None, "2020-01-01")], "id INT, a STRING, b STRING")
    assert [r["id"] for r in fields.validate_order(df, "a", "b").collect()] == [1]


def test_conflicts_list_every_value(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", None), (None, "p"), (None, "q")]
    df = spark.createDataFrame(rows, "who STRING, v STRING")
    got = sorted(fields.field_conflicts(df, ["who"], "v").collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("a", "x", 2, 2), ("a", "y", 1, 2), (None, "p", 1, 2), (None, "q", 1, 2)], key=repr
    )


def test_fuzzy_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["COMMON START " + "".join(rng.choice("ABC") for _ in range(rng.randint(0, 5))) for _ in range(60)]
    names = base + base[:20] + ["", "A"]
    blocks = [rng.choice("xy") for _ in names]
    df = spark.createDataFrame(list(zip(blocks, names)), "block STRING, name STRING")
    for k in (1, 2):
        got = {(r[0], r[1], r[2], r[5]) for r in fields.fuzzy_matches(df, None, ["block"], "name", k).collect()}
        want = set()
        for block in "xy":
            values = sorted({n for b, n in zip(blocks, names) if b == block})
            for a, b in itertools.combinations(values, 2):
                if lev(a, b) <= k:
                    want.add((block, a, b, lev(a, b)))
        assert got == want


@pytest.mark.parametrize("hot_pairs", [0, 3, 10**6])
def test_fuzzy_short_and_edited_values(spark, hot_pairs):
    rng = random.Random(7)
    made = {"", "A", "AB", "BA", "ABC", "Ü", "ÜB", "日本", "日本語"}
    for _ in range(40):
        made.add("".join(rng.choice("AÜB") for _ in range(rng.randint(1, 12))))
    for value in list(made)[:30]:
        letters = list(value + "AB")
        for _ in range(rng.randint(1, 4)):
            place = rng.randrange(len(letters) + 1)
            letters[place : place + rng.randint(0, 1)] = rng.choice(["", "B", "Ü"])
        made.add("".join(letters))
    names = sorted(made)
    a, b = names[::2], names[1::2]
    frames = [spark.createDataFrame([(1, n) for n in side], "block INT, name STRING") for side in (a, b)]
    for k in (1, 2, 3):
        got = {(r[1], r[2], r[5]) for r in fields.fuzzy_matches(*frames, ["block"], "name", k, hot_pairs=hot_pairs).collect()}
        assert got == {(x, y, lev(x, y)) for x in a for y in b if lev(x, y) <= k}, k


def test_fuzzy_candidates_do_not_grow_with_length(spark):
    from idscreen.functions import text

    sizes = []
    for length in (30, 300):
        frame = spark.createDataFrame([("".join(chr(65 + (k * k + k // 7) % 26) for k in range(length)),)], "v STRING")
        sizes.append((text.segment_probes(frame, "v", 3).count(), text.segments(frame, "v", 3).count()))
    assert sizes[0][0] <= 60 and sizes[1] == sizes[0] and sizes[0][1] == 4


def test_fuzzy_two_sides_counts_rows(spark):
    left = spark.createDataFrame([("b", "ANNA"), ("b", "ANNA"), ("b", "OTTO")], "block STRING, name STRING")
    right = spark.createDataFrame([("b", "ANA"), ("b", "ANNA"), ("c", "OTTO")], "block STRING, name STRING")
    got = sorted(map(tuple, fields.fuzzy_matches(left, right, ["block"], "name", 1).collect()))
    assert got == [("b", "ANNA", "ANA", 2, 1, 1), ("b", "ANNA", "ANNA", 2, 1, 0)]


def test_unpivot_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a", None)], "id INT, x STRING, y INT")
    assert sorted(map(tuple, fields.unpivot_fields(df, ["id"], ["x", "y"]).collect())) == [(1, "x", "a"), (1, "y", None)]
