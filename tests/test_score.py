from __future__ import annotations

from datetime import datetime

import pytest

from idscreen.operators import score

AT = datetime(2024, 1, 1)
SIGNALS = "case_id STRING, signal STRING, value DOUBLE, at TIMESTAMP_NTZ, event_id INT"


def test_latest_signal_wins(spark):
    a = spark.createDataFrame([("c", "s", 0.1, AT, 1), ("c", "s", 0.9, AT, 3), ("c", "t", 0.5, None, 9)], SIGNALS)
    b = spark.createDataFrame([("c", "s", 0.4, AT, 2)], SIGNALS)
    got = sorted((r["signal"], r["value"], r["event_id"]) for r in score.collect_signals(a, b).collect())
    assert got == [("s", 0.9, 3), ("t", 0.5, 9)]


def test_matrix(spark):
    df = spark.createDataFrame([("c", "s", 0.1, AT, 1), ("c", "t", None, AT, 1), ("d", "x", 1.0, AT, 1)], SIGNALS)
    got = sorted(map(tuple, score.signal_matrix(df, ["s", "t"]).collect()))
    assert got == [("c", 0.1, None), ("d", None, None)]


@pytest.mark.parametrize(("missing", "want"), [("skip", 0.625), ("zero", 0.5), ("worst", 0.7)])
def test_missing_policies(spark, missing, want):
    df = spark.createDataFrame([("c", "a", 2.0, AT, 1), ("c", "b", 0.25, AT, 1), ("c", "other", 1.0, AT, 1), ("c", "d", None, AT, 1)], SIGNALS)
    weights = spark.createDataFrame([("a", 0.4), ("b", 0.4), ("d", 0.2)], "signal STRING, weight DOUBLE")
    people = spark.createDataFrame([("c",), ("none",)], "case_id STRING")
    got = {r["case_id"]: r["score"] for r in score.risk_score(df, weights, missing, cases=people).collect()}
    assert got == {"c": want, "none": None}


def test_score_is_rounded_before_bands(spark):
    # 0.1 + 0.3 in doubles is above 0.4; in exact sums it is the edge itself, which belongs to the upper band.
    df = spark.createDataFrame([("c", "a", 1.0, AT, 1), ("c", "b", 1.0, AT, 1), ("c", "d", 0.0, AT, 1)], SIGNALS)
    scored = score.risk_decision(score.risk_score(df, [("a", 0.1), ("b", 0.3), ("d", 0.6)]))
    assert [(r["score"], r["decision"]) for r in scored.collect()] == [(0.4, "review")]


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.399999,), (0.4,), (0.699999,), (0.7,), (1.0,), (None,)], "score DOUBLE")
    bands = spark.createDataFrame(score.DEFAULT_BANDS, "lo DOUBLE, hi DOUBLE, decision STRING")
    for rows in (bands, score.DEFAULT_BANDS):
        got = [r["decision"] for r in score.risk_decision(df, rows).collect()]
        assert got == ["clear", "clear", "review", "review", "refer", "refer", "review"]


def test_settings_of_any_size(spark):
    df = spark.createDataFrame([("c", "1", 1.0, AT, 1), ("c", "4999", 0.0, AT, 1)], SIGNALS)
    weights = spark.range(5_000).selectExpr("string(id) AS signal", "IF(id = 1, 3000D, 0.0000001D) AS weight")
    assert [r["score"] for r in score.risk_score(df, weights).collect()] == [1.0]
    small = weights.selectExpr("signal", "IF(signal = '1', 0.0000003D, 0.0000001D) AS weight")
    assert [r["score"] for r in score.risk_score(df, small).collect()] == [0.75]
    bands = spark.range(5_000).selectExpr("id / 5000D AS lo", "(id + 1) / 5000D AS hi", "string(id) AS decision")
    scores = spark.createDataFrame([(0.5,), (1.0,), (None,)], "score DOUBLE")
    assert [r["decision"] for r in score.risk_decision(scores, bands).collect()] == ["2500", "4999", "review"]


def test_weights_are_checked(spark):
    df = spark.createDataFrame([("c", "a", 1.0, AT, 1)], SIGNALS)
    with pytest.raises(Exception, match="negative"):
        score.risk_score(df, spark.createDataFrame([("a", -1.0), ("b", 2.0)], "signal STRING, weight DOUBLE")).collect()
    with pytest.raises(ValueError, match="negative"):
        score.risk_score(df, [("a", -1.0), ("b", 2.0)])
    with pytest.raises(ValueError, match="missing"):
        score.risk_score(df, [("a", 1.0)], "guess")


def test_reasons_break_ties_by_name(spark):
    df = spark.createDataFrame([("c", s, 0.5, AT, 1) for s in "dcba"] + [("c", "x", None, AT, 1)], SIGNALS)
    got = sorted(map(tuple, score.top_reasons(df, [("a", 0.2), ("b", 0.2), ("c", 0.4), ("d", 0.1), ("x", 1)], 3).collect()))
    assert got == [("c", 1, "c", 0.2), ("c", 2, "a", 0.1), ("c", 3, "b", 0.1)]


def test_queue_ranks_ties(spark):
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate([5.0, 7.0, 7.0, 6.0, 5.0, 1.0])], "place_id STRING, case_id INT, score DOUBLE")
    got = sorted(map(tuple, score.review_queue(df, ["place_id"], 4).collect()), key=lambda r: r[3])
    assert got == [("p", 1, 7.0, 1, 1, 1), ("p", 2, 7.0, 2, 1, 1), ("p", 3, 6.0, 3, 3, 2), ("p", 0, 5.0, 4, 4, 3)]
    assert [r["case_id"] for r in score.first_in_queue(df, 2).collect()] == [1, 2]


def test_quality_with_ties_and_no_hits(spark):
    rows = [(1, 0.9, 1), (2, 0.5, 1), (3, 0.5, 0), (4, 0.1, 0), (5, None, 1), (6, 0.3, None)]
    scores = spark.createDataFrame([(c, s) for c, s, _ in rows], "case_id INT, score DOUBLE")
    labels = spark.createDataFrame([(c, y) for c, _, y in rows], "case_id INT, label INT")
    got = {r["threshold"]: r for r in score.detection_quality(scores, labels, [0.5, 2.0]).collect()}
    assert tuple(got[0.5])[1:] == (2, 1, 1, 0, 0.666667, 1.0, 0.875)
    assert (got[2.0]["precision"], got[2.0]["recall"]) == (None, 0.0)
    only = score.detection_quality(scores.where("case_id = 1"), labels, [0.5]).collect()[0]
    assert only["auc"] is None


def test_calibration_keeps_equal_scores_together(spark):
    values = [0.1] * 50 + [0.2, 0.3, 0.4, 0.5]
    scores = spark.createDataFrame(list(enumerate(values)), "case_id INT, score DOUBLE")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(values))], "case_id INT, label INT")
    got = {r["bin"]: r["cases"] for r in score.calibration(scores, labels, 2).collect()}
    assert got == {1: 50, 2: 4}
    width = {r["bin"]: r["cases"] for r in score.calibration(scores, labels, 2, method="width").collect()}
    assert width == {1: 53, 2: 1}


def test_error_rates(spark):
    scored = spark.createDataFrame([(1, 0.9), (2, 0.4), (3, 0.6), (4, 0.2)], "id INT, score DOUBLE")
    truth = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "id INT, same BOOLEAN")
    got = [tuple(r) for r in score.match_error_rates(scored, truth, [0.5, 0.95], ["id"]).collect()]
    assert got == [(0.5, 1, 1, 0.5, 0.5), (0.95, 0, 2, 0.0, 1.0)]
    more = truth.unionAll(spark.createDataFrame([(5, True), (6, False)], truth.schema))
    points = spark.createDataFrame([(0.5,)], "threshold DOUBLE")
    assert [tuple(r) for r in score.match_error_rates(scored, more, points, ["id"]).collect()] == [(0.5, 1, 2, 0.333333, 0.666667)]
