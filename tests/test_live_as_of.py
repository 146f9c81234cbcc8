"""Live lookups against registry versions that arrive as a stream."""

from __future__ import annotations

import datetime as dt

import pytest

from idscreen.operators.registry import registry_as_of
from idscreen.streaming import as_of, live

BASE = dt.datetime(2024, 1, 1)
RECORDS = "rec_id bigint, person string, at timestamp, note string"
VERSIONS = "ver_id bigint, person string, since timestamp, status string, until timestamp"


def _t(minutes, micros=0):
    return None if minutes is None else BASE + dt.timedelta(minutes=minutes, microseconds=micros)


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def _stream(spark, path, schema, ts):
    return live.read_events(spark, str(path), schema, ts, files_per_batch=1)


def _run(spark, tmp_path, out, spread=1, valid_to=None):
    looked = as_of.live_registry_as_of(
        _stream(spark, tmp_path / "records", RECORDS, "at"),
        _stream(spark, tmp_path / "versions", VERSIONS, "since"),
        "person",
        "at",
        record_order="rec_id",
        version_ts="since",
        version_order="ver_id",
        values=["status"],
        delay="10 minutes",
        valid_to=valid_to,
        spread=spread,
    )
    with as_of.rocksdb_state(spark):
        run = live.run_once(looked, str(tmp_path / out), str(tmp_path / f"{out}-state"))
    return run, spark.read.schema(looked.schema).parquet(run.path)


@pytest.mark.parametrize("spread", [1, 3])
def test_equals_batch_on_closed_time(spark, tmp_path, spread):
    people = ["ann", "bob", "cy", "dee", "eve"]
    records = [(k, people[k % 5] if k % 11 else None, _t(7 * k, k), f"n{k}") for k in range(60)]
    versions = [(k, people[k % 4], _t(23 * k, k % 2), f"s{k}", _t(23 * k + 60) if k % 3 else None) for k in range(19)]
    versions += [(100 + k, "ann", _t(70), f"tie{k}", None) for k in range(3)] + [(200, "bob", None, "never", None)]
    records += [(900, "ann", _t(10_000), "last")]
    versions += [(900, "zed", _t(10_000), "last", None)]
    # versions lag behind records and come out of order, but no more than the delay allows
    versions.sort(key=lambda v: (v[2] is not None, v[2] and v[2] + dt.timedelta(minutes=9 * (v[0] % 2)), v[0]))
    for part in range(4):
        _write(spark, records[part * 20 : part * 20 + 20], RECORDS, tmp_path / "records")
        _write(spark, versions[part * 6 : part * 6 + 6], VERSIONS, tmp_path / "versions")
    _, got = _run(spark, tmp_path, "out", spread, "until")
    batch = registry_as_of(
        spark.createDataFrame(records, RECORDS), spark.createDataFrame(versions, VERSIONS), "person", "at",
        record_order="rec_id", version_ts="since", version_order="ver_id", values=["status"], valid_to="until",
    )
    closed = _t(10_000) - dt.timedelta(minutes=10)
    want = sorted(map(repr, (tuple(r) for r in batch.collect() if r["at"] <= closed)))
    assert sorted(map(repr, map(tuple, got.select(batch.columns).collect()))) == want


def test_file_added_between_runs_is_seen_and_late_rows_are_counted(spark, tmp_path):
    _write(spark, [(1, "ann", _t(100), "a"), (2, "ann", _t(140), "b")], RECORDS, tmp_path / "records")
    _write(spark, [(1, "ann", _t(90), "old", None), (2, "x", _t(120), "", None)], VERSIONS, tmp_path / "versions")
    _, got = _run(spark, tmp_path, "out")
    assert {r.rec_id: r.status for r in got.collect()} == {1: "old"}  # the slower stream has closed 110 only
    _write(spark, [(3, "ann", _t(130), "new", None), (4, "x", _t(400), "", None)], VERSIONS, tmp_path / "versions")
    _write(spark, [(3, "ann", _t(400), "c")], RECORDS, tmp_path / "records")
    _, got = _run(spark, tmp_path, "out")
    assert {r.rec_id: r.status for r in got.collect()} == {1: "old", 2: "new"}
    _write(spark, [(5, "ann", _t(135), "too late", None), (6, "x", _t(900), "", None)], VERSIONS, tmp_path / "versions")
    _write(spark, [(4, "ann", _t(900), "d")], RECORDS, tmp_path / "records")
    run, got = _run(spark, tmp_path, "out")
    assert {r.rec_id: r.status for r in got.collect()} == {1: "old", 2: "new", 3: "new"} and run.rows_late == 1


def test_records_without_key_or_time(spark, tmp_path):
    _write(spark, [(1, None, _t(5), "a"), (2, "ann", None, "b"), (3, "x", _t(900), "")], RECORDS, tmp_path / "records")
    _write(spark, [(1, "ann", _t(1), "s", None), (2, "x", _t(900), "", None)], VERSIONS, tmp_path / "versions")
    _, got = _run(spark, tmp_path, "out")
    assert sorted((r.rec_id, r.status) for r in got.collect()) == [(1, None), (2, None)]
