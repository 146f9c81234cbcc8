"""Streams over input cut into files, so that watermarks move between micro-batches; the last file is late."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from idscreen.operators import trail
from idscreen.sources.scratch import fresh_dir, shared_dir
from idscreen.streaming import cases, live

SCHEMA = "event_id INT, ts TIMESTAMP_NTZ, case_id STRING, stage STRING"
START = datetime(2024, 1, 1)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("events")
    files = [
        [(1, at(0), "a", "face"), (2, at(20), "a", "text"), (3, at(50), "a", "face"), (4, at(5), "b", "face")],
        [(5, at(81), "a", "face"), (6, at(200), "b", "text"), (7, at(205), "c", "face")],
        [(8, at(210), "c", "text"), (9, at(400), "d", "face")],
        [(10, at(3), "a", "face"), (11, at(900), "z", "face")],
    ]
    for n, rows in enumerate(files):
        target = path / f"part-{n}.parquet"
        spark.createDataFrame(rows, SCHEMA).toPandas().to_parquet(target, coerce_timestamps="us")
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(path)


def stream(spark, folder):
    return live.read_events(spark, folder, SCHEMA, "ts", files_per_batch=1)


def run(spark, df):
    done = live.run_once(df, fresh_dir(spark, "out"), fresh_dir(spark, "state"))
    return done, spark.read.schema(df.schema).parquet(done.path)


def test_windows_and_late_rows(spark, folder):
    done, out = run(spark, live.window_counts(stream(spark, folder), "ts", [], "1 hour", None, "10 minutes"))
    assert done.rows_in >= 11 and done.rows_late == 1
    got = {(r["window_start"] - START).seconds // 60: r["events"] for r in out.collect()}
    assert got == {0: 4, 60: 1, 180: 3, 360: 1}


def test_counters_cover_every_batch_or_fail(spark, folder):
    counts = live.window_counts(stream(spark, folder), "ts", [], "1 hour", None, "10 minutes")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        done, _ = run(spark, counts)
        assert done.batches >= 4 and done.rows_in == 11 and done.rows_late == 1
    except RuntimeError as error:
        assert "no report is left" in str(error)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_sessions_equal_batch_when_closed(spark, folder):
    _, out = run(spark, live.live_sessions(stream(spark, folder), "case_id", "ts", "30 minutes", "10 minutes"))
    got = sorted((r["case_id"], r["session_start"], r["session_end"], r["events"]) for r in out.collect())
    batch = spark.read.schema(SCHEMA).parquet(folder).where("event_id <> 10")
    want = sorted(map(tuple, trail.sessions(batch, "case_id", "ts", "event_id", 1_800).where("case_id <> 'z'").collect()))
    assert got == want
    assert ("a", at(0), at(50), 3) in got and ("a", at(81), at(81), 1) in got


def test_repeats_across_files(spark, folder):
    _, out = run(spark, live.drop_repeats(stream(spark, folder), "ts", ["case_id", "stage"], "2 hours"))
    got = sorted((r["case_id"], r["stage"]) for r in out.collect())
    assert got == sorted([("a", "face"), ("a", "text"), ("b", "face"), ("b", "text"), ("c", "face"), ("c", "text"), ("d", "face"), ("z", "face")])


@pytest.mark.parametrize("spread", [1, 3])
def test_join_within(spark, folder, spread):
    faces = stream(spark, folder).where("stage = 'face'").select("case_id", F.col("ts").alias("face_at"))
    texts = stream(spark, folder).where("stage = 'text'").select("case_id", F.col("ts").alias("text_at"))
    _, out = run(spark, live.join_within(faces, texts, ["case_id"], "face_at", "text_at", "30 minutes", "10 minutes", spread))
    got = sorted((r["case_id"], r["face_at"], r["text_at"]) for r in out.collect())
    assert got == [("a", at(0), at(20)), ("c", at(205), at(210))]


def test_registry_check_on_stream(spark, folder):
    known = spark.createDataFrame([("a", "face")], "case_id STRING, stage STRING")
    _, out = run(spark, live.live_registry_check(stream(spark, folder), known, ["case_id"], ["stage"]))
    got = {r["event_id"]: r["status"] for r in out.collect()}
    assert (got[1], got[2], got[4]) == ("found", "mismatch", "not_found") and len(got) == 11


def test_cases_complete_or_time_out(spark, folder):
    # The second signal of case b comes after its time has run out and does not open the case again.
    rows = stream(spark, folder).select("case_id", F.col("stage").alias("signal"), F.col("ts").alias("at"))
    _, out = run(spark, cases.complete_cases(rows, ["face", "text"], 3_600, "10 minutes"))
    got = sorted((r["case_id"], r["status"], r["first_at"], r["last_at"], r["missing"]) for r in out.collect())
    assert got == [
        ("a", "complete", at(0), at(20), ""),
        ("b", "timed_out", at(5), at(5), "text"),
        ("c", "complete", at(205), at(210), ""),
        ("d", "timed_out", at(400), at(400), "text"),
    ]


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    """Only what the lookup of the shared folder reads; the real setting is fixed once a session has started."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = _Context(master), {"spark.checkpoint.dir": folder}


def test_shared_folder_comes_from_the_session():
    cluster = _Session("spark://host:7077", "hdfs://shared/folder/")
    assert shared_dir(cluster) == "hdfs://shared/folder"
    assert cluster.sparkContext.folder == "hdfs://shared/folder/"
    assert fresh_dir(cluster, "x").startswith("hdfs://shared/folder/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://host:7077"))
    assert shared_dir(_Session("local[2]"))
