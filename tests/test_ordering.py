"""Order-dependent operators give the same when a hot key is cut into chunks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from idscreen.functions.ordering import in_order, micros
from idscreen.functions.quantiles import cumulative, percentiles
from idscreen.operators import registry, report, trail

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    """A third of the rows belong to one case; some times are equal or null; one case is null."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        case = 1 if i % 3 == 0 else rng.choice([2, 3, 4, 5, None])
        ts = START + timedelta(minutes=10 * rng.randint(0, 900))
        rows.append((case, ts if i % 50 else None, i, rng.choice("abc"), rng.choice([None, rng.random()])))
    return spark.createDataFrame(rows, "case_id INT, ts TIMESTAMP_NTZ, event_id INT, state STRING, v DOUBLE").cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_in_order_with_chunks(events):
    def run(hot_rows):
        return in_order(
            events, ["case_id"], ["ts", "event_id"], micros("ts"), 86_400e6, number="n", previous={"p": "v"},
            following={"f": "state"}, last_seen={"s": "v"}, first={"a": "v"}, last={"z": "state"}, hot_rows=hot_rows,
        )

    assert rows(run(100)) == rows(run(10**9))
    by_case = {}
    for r in sorted(run(100).collect(), key=lambda r: r["n"]):
        by_case.setdefault(r["case_id"], []).append(r)
    for case, got in by_case.items():
        order = sorted(got, key=lambda r: (r["ts"] or datetime.min, r["event_id"]))
        assert [r["n"] for r in order] == list(range(1, len(order) + 1))
        assert [r["p"] for r in order] == [None] + [r["v"] for r in order[:-1]]
        assert [r["f"] for r in order] == [r["state"] for r in order[1:]] + [None]
        seen, want = None, []
        for r in order:
            seen = seen if r["v"] is None else r["v"]
            want.append(seen)
        assert [r["s"] for r in order] == want
        assert {r["a"] for r in order} == {order[0]["v"]} and {r["z"] for r in order} == {order[-1]["state"]}


def test_operators_with_chunks(events):
    for hot in (50, 10**9):
        timeline = trail.case_timeline(events, "case_id", "ts", "event_id", "state", 40_000, hot)
        sessions = trail.sessions(events, "case_id", "ts", "event_id", 1_800, 40_000, hot)
        times = report.stage_times(events, "case_id", "ts", "state", "event_id", "exact", 40_000, hot)
        current = rows(timeline), rows(sessions), rows(times)
        if hot == 50:
            first = current
    assert first == current


def test_session_edge(spark):
    at = [0, 30, 60, 90.02]
    df = spark.createDataFrame([(1, START + timedelta(minutes=m), i) for i, m in enumerate(at)], "c INT, ts TIMESTAMP_NTZ, id INT")
    got = [(r["session_start"], r["session_end"], r["events"]) for r in trail.sessions(df, "c", "ts", "id", 1_800).collect()]
    assert sorted(got) == [
        (START, START + timedelta(minutes=60), 3),
        (START + timedelta(minutes=90.02), START + timedelta(minutes=90.02), 1),
    ]


def test_as_of_with_chunks_and_end(events, spark):
    versions = events.select("case_id", F.col("ts").alias("since"), F.col("event_id").alias("vid"), "state", (F.col("ts") + F.expr("INTERVAL '6' HOUR")).alias("until"))
    records = events.select("case_id", (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("at"), F.col("event_id").alias("rid"))
    every = [r.asDict() for r in versions.collect() if r["case_id"] is not None]
    for hot in (50, 10**9):
        got = registry.registry_as_of(
            records, versions, "case_id", "at", record_order="rid", version_ts="since", version_order="vid",
            values=["state", "vid"], valid_to="until", chunk_seconds=40_000, hot_rows=hot,
        ).collect()
        assert len(got) == records.count()
        for r in got:
            before = [v for v in every if r["at"] and v["since"] and v["case_id"] == r["case_id"] and v["since"] <= r["at"]]
            best = max(before, key=lambda v: (v["since"], v["vid"]), default=None)
            if best is None or best["until"] <= r["at"]:
                assert (r["state"], r["vid"], r["version_from"]) == (None, None, None)
            else:
                assert (r["state"], r["vid"], r["version_from"]) == (best["state"], best["vid"], best["since"])


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = [("a", float(x)) for x in rng.normal(0, 1e3, 101)] + [("b", float(x)) for x in rng.integers(-2, 3, 80)]
    data += [(None, 7.0), ("c", None)]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE")
    points = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0}
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", points).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        values = [v for k, v in data if k == g and v is not None]
        for name, p in points.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    alone = percentiles(df, [], "v", {"m": 0.5}).collect()
    assert alone[0]["m"] == pytest.approx(np.median([v for _, v in data if v is not None]))


def test_cumulative(spark):
    df = spark.createDataFrame([(x / 10, x * x + 1) for x in range(-20, 20)], "v DOUBLE, n INT")
    for r in cumulative(df, "v", ["n"]).collect():
        want = sum(x * x + 1 for x in range(-20, 20) if x / 10 < r["v"])
        assert (r["below_n"], r["total_n"]) == (want, sum(x * x + 1 for x in range(-20, 20)))


def test_micros_of_plain_timestamps_ignore_the_session_zone(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 01:30:00' AS a, TIMESTAMP_NTZ'2024-03-10 03:30:00' AS b")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows.select((micros("b") - micros("a")).alias("d")).collect()[0]["d"] == 7_200_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
