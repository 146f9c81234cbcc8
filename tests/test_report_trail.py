from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from idscreen.operators import registry, report, trail
from idscreen.sources.trail_store import read_trail, trail_append

TRAIL = "case_id STRING, seq INT, actor STRING, payload STRING"


def test_registry_check(spark):
    records = spark.createDataFrame([(1, "A", "x"), (2, "B", "y"), (3, "C", None), (4, "D", "z"), (5, None, "z")], "id INT, no STRING, name STRING")
    known = spark.createDataFrame([("A", "x"), ("B", "q"), ("C", None)], "no STRING, name STRING")
    got = {r["id"]: (r["status"], r["differing"]) for r in registry.registry_check(records, known, ["no"], ["name"]).collect()}
    assert got == {1: ("found", []), 2: ("mismatch", ["name"]), 3: ("found", []), 4: ("not_found", []), 5: ("not_found", [])}
    assert sorted(r["id"] for r in registry.not_in_registry(records, known, ["no"]).collect()) == [4, 5]
    assert sorted(r["id"] for r in registry.listed(records, known.unionAll(known), ["no"]).collect()) == [1, 2, 3]


def test_summary_modes(spark):
    df = spark.createDataFrame([("r", "n", True), ("r", "m", False), (None, "m", True)], "a STRING, b STRING, bad BOOLEAN")
    rollup = {(r["level"], r["a"], r["b"]): (r["cases"], r["flagged"], r["flagged_rate"]) for r in report.checkpoint_summary(df, ["a", "b"], flag="bad").collect()}
    assert rollup[(3, None, None)] == (3, 2, 0.666667)
    assert rollup[(1, None, None)] == (1, 1, 1.0) and rollup[(1, "r", None)] == (2, 1, 0.5)
    assert len(report.checkpoint_summary(df, ["a", "b"], "cube").collect()) == 8
    assert len(report.checkpoint_summary(df, ["a", "b"], "sets", sets=[["b"]]).collect()) == 2
    with pytest.raises(ValueError):
        report.checkpoint_summary(df, ["a"], "pivot")


def test_deviation_without_spread(spark):
    df = spark.createDataFrame([("p", False), ("q", False)], "place STRING, bad BOOLEAN")
    assert {r["z"] for r in report.checkpoint_deviation(df, "place", "bad").collect()} == {None}


def test_trend_rejects_fine_units(spark):
    with pytest.raises(ValueError):
        report.volume_trend(spark.range(1), "id", "second")


def rows(n=10):
    return [("c", i, "a", f"p{i}") for i in range(n)] + [("d", 0, None, "")]


def test_digest_sees_every_change(spark):
    base = {r["case_id"]: r["digest"] for r in trail.trail_digest(spark.createDataFrame(rows(), TRAIL), "case_id", "seq", segment=3).collect()}
    again = trail.trail_digest(spark.createDataFrame(rows()[::-1], TRAIL).repartition(5), "case_id", "seq", segment=3)
    assert {r["case_id"]: r["digest"] for r in again.collect()} == base
    for at, new in [(0, ("c", 0, "b", "p0")), (9, ("c", 9, "a", "")), (10, ("d", 0, "", None))]:
        edited = rows()
        edited[at] = new
        now = {r["case_id"]: r["digest"] for r in trail.trail_digest(spark.createDataFrame(edited, TRAIL), "case_id", "seq", segment=3).collect()}
        assert [c for c in base if now[c] != base[c]] == [new[0]]


def test_verify_finds_planted_faults(spark):
    stored = trail.trail_digest(spark.createDataFrame(rows() + [("gone", 0, "a", "x")], TRAIL), "case_id", "seq", segment=4)
    edited = [r for r in rows() if r[1] != 5] + [("new", 0, "a", "x")]
    got = {r["case_id"]: (r["status"], r["rows_then"], r["rows_now"]) for r in trail.trail_verify(spark.createDataFrame(edited, TRAIL), stored, "case_id", "seq", segment=4).collect()}
    assert got == {"c": ("changed", 10, 9), "d": ("same", 1, 1), "gone": ("missing", 1, None), "new": ("extra", None, 1)}


def test_diff_counts_duplicates(spark):
    old = spark.createDataFrame([("a", 1)] * 3 + [("b", None)], "k STRING, n INT")
    new = spark.createDataFrame([("a", 1)] + [("b", None)] * 3 + [("c", 2)], "k STRING, n INT")
    got = sorted(map(tuple, trail.trail_diff(old, new).collect()))
    assert got == [("a", 1, "removed", 2), ("b", None, "added", 2), ("c", 2, "added", 1)]


def test_append_only_adds(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "case_id STRING, seq INT, at TIMESTAMP_NTZ"
    first = spark.createDataFrame([("c", i, at + timedelta(hours=12 * i)) for i in range(4)], schema)
    path = str(tmp_path / "trail")
    trail_append(first, path, "one", "at")
    trail_append(first.withColumn("seq", F.col("seq") + 10), path, "two", "at")
    trail_append(first.orderBy(F.desc("seq")).withColumn("seq", F.col("seq") + 10), path, "two", "at")  # the same rows
    for other in (first.withColumn("seq", F.col("seq") + 20), first.where("seq = 0"), first.union(first)):
        with pytest.raises(ValueError, match="other rows"):
            trail_append(other, path, "two", "at")
    got = read_trail(spark, path, schema)
    assert sorted(r["seq"] for r in got.collect()) == [0, 1, 2, 3, 10, 11, 12, 13]
    assert got.where("event_date = DATE'2024-01-02' AND batch_id = 'one'").count() == 2
    trail_append(first.where("seq = 0"), path, "a/b = c", "at")
    trail_append(first.where("seq = 0"), path, "a/b = c", "at")
    trail_append(first.where("seq > 90"), path, "empty", "at")
    again = sorted((r["batch_id"], r["seq"]) for r in read_trail(spark, path, schema).where("seq < 4").collect())
    assert again == [("a/b = c", 0), ("one", 0), ("one", 1), ("one", 2), ("one", 3)]


def test_a_lost_append_leaves_nothing_to_read(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "case_id STRING, seq INT, at TIMESTAMP_NTZ"
    rows = spark.createDataFrame([("c", i, at) for i in range(40)], schema).repartition(4)
    broken = rows.withColumn("seq", F.when(F.col("seq") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("seq")))
    path = str(tmp_path / "trail")
    trail_append(rows.where("seq = 0"), path, "one", "at")
    with pytest.raises(Exception, match="lost"):
        trail_append(broken, path, "two", "at")
    assert read_trail(spark, path, schema).count() == 1
    trail_append(rows, path, "two", "at")
    assert read_trail(spark, path, schema).count() == 41


def test_row_digests_tell_shifted_separators_and_nulls_apart(spark):
    from idscreen.functions.digest import row_text

    rows = [("x\x1fy", "z"), ("x", "y\x1fz"), (None, "z"), ("\x00", "z"), ("", "z"), ("-:", "z"), ("1:x", "z"), ("x", "1:z")]
    frame = spark.createDataFrame(rows, "a STRING, b STRING")
    assert frame.select(row_text(["a", "b"]).alias("t")).distinct().count() == len(rows)


def test_as_of_takes_the_later_version_of_one_instant(spark):
    at = datetime(2024, 1, 1)
    versions = spark.createDataFrame([("k", at, 9, "old"), ("k", at, 10, "new")], "k STRING, since TIMESTAMP_NTZ, vid INT, state STRING")
    records = spark.createDataFrame([("k", at, 1)], "k STRING, at TIMESTAMP_NTZ, rid INT")
    got = registry.registry_as_of(
        records, versions, "k", "at", record_order="rid", version_ts="since", version_order="vid", values=["state"]
    )
    assert [r["state"] for r in got.collect()] == ["new"]
