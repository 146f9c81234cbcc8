"""Stored sketches against exact answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from idscreen.operators import sketches


def _events(spark, n=60_000):
    day = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 30.0)")
    group = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "mid").otherwise("low")
    value = F.when(F.col("id") % 13 == 0, None).otherwise(F.pow(F.col("id") % 1_009, 2) / 7 + 1.7e9)
    return spark.range(n).select(group.alias("g"), day.alias("ts"), value.alias("v"), (F.col("id") % 5_003).alias("person"))


def test_merged_quantiles_within_the_bound(spark, tmp_path):
    events = _events(spark)
    path = str(tmp_path / "sketches")
    stored = sketches.value_sketches(events, ["g"], "ts", "v")
    for part in (0, 1):  # two batches of days, stored apart
        stored.where(F.dayofmonth("day") % 2 == part).write.mode("append").parquet(path)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = sketches.merged_quantiles(spark.read.parquet(path), ["g"], shares).collect()
    assert len(got) == 15
    values = {g: sorted(r.v for r in events.where((F.col("g") == g) & F.col("v").isNotNull()).collect()) for g in ("hot", "mid", "low")}
    for r in got:
        held = values[r.g]
        below, upto = sum(v < r.estimate for v in held) / len(held), sum(v <= r.estimate for v in held) / len(held)
        assert r.n == len(held) and below - sketches.rank_error() <= r.share <= upto + sketches.rank_error()


def test_distinct_and_shared_persons(spark):
    events = _events(spark)
    groups = sketches.distinct_persons(sketches.person_sketches(events, ["g"], "ts", "person"), ["g"])
    seen = {g: {r.person for r in events.where(F.col("g") == g).collect()} for g in ("hot", "mid", "low")}
    for r in groups.collect():
        assert abs(r.persons - len(seen[r.g])) <= sketches.count_error() * len(seen[r.g])
    pairs = spark.createDataFrame([("hot", "mid"), ("mid", "low")], "a string, b string")
    for r in sketches.shared_persons(groups, pairs, "g").collect():
        union = len(seen[r.a] | seen[r.b])
        assert abs(r.shared - len(seen[r.a] & seen[r.b])) <= sketches.count_error() * union


def test_nothing(spark):
    none = _events(spark, 10).where("g = 'no'")
    assert sketches.merged_quantiles(sketches.value_sketches(none, ["g"], "ts", "v"), ["g"], [0.5]).count() == 0
    assert sketches.distinct_persons(sketches.person_sketches(none, ["g"], "ts", "person"), ["g"]).count() == 0
