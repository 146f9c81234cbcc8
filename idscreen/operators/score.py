"""From signals to a risk score, a decision and its quality."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idscreen.functions.quantiles import cumulative

DEFAULT_BANDS = [(0.0, 0.4, "clear"), (0.4, 0.7, "review"), (0.7, 1.0, "refer")]
MISSING = ("skip", "zero", "worst")


def collect_signals(*frames: DataFrame, case: Sequence[str] = ("case_id",)) -> DataFrame:
    """Union of signal frames (case, signal, value, at, event_id), the latest per case and signal."""
    together = frames[0]
    for frame in frames[1:]:
        together = together.unionByName(frame)
    latest = together.groupBy(*case, "signal").agg(
        F.max_by(F.struct("value", "at", "event_id"), F.struct("at", "event_id")).alias("_last")
    )
    return latest.select(*case, "signal", "_last.*")


def signal_matrix(signals: DataFrame, names: Sequence[str], case: Sequence[str] = ("case_id",)) -> DataFrame:
    """One row per case, one column per named signal (the largest value), in a single aggregation."""
    return signals.groupBy(*case).agg(*[F.max(F.when(F.col("signal") == n, F.col("value"))).alias(n) for n in names])


# Values count in steps of 1e-9 and weights in steps of 1e-12, so that sums are whole numbers: they do not depend on
# row order, and a score is rounded from the exact quotient.
VALUE_STEPS = 1_000_000_000
LOWEST = -1.7976931348623157e308
WEIGHT_STEPS = 1_000_000_000_000
STEPS_TYPE = "decimal(25,0)"


def _weighted(signals: DataFrame, weights: DataFrame | Sequence[tuple[str, float]]) -> tuple[DataFrame, Column]:
    """Signals with `_weight` in steps, null for a signal without one, and the sum of all weights.

    A table of weights is joined, whatever its size; a sequence becomes part of the plan.
    """
    wrong = "weights must not be negative and must add up to more than 0"
    if isinstance(weights, DataFrame):
        exact = F.round(F.col("weight").cast("decimal(38,12)") * WEIGHT_STEPS, 0).cast(STEPS_TYPE)
        steps = weights.select("signal", exact.alias("_weight"))
        sums = steps.agg(F.sum("_weight").alias("_sum"), F.min("_weight").alias("_least"))
        usable = (F.col("_least") >= 0) & (F.col("_sum") > 0)
        whole = F.when(usable, F.col("_sum")).otherwise(F.raise_error(F.lit(wrong)).cast("decimal(35,0)"))
        total = sums.select(whole.alias("_whole")).scalar()
        joined = signals.join(steps, "signal", "left")
        # Read with every weight, so that wrong weights are an error under each policy.
        return joined.withColumn("_weight", F.when(total > 0, F.col("_weight"))), total
    pairs = [(n, round(Decimal(repr(float(w))) * WEIGHT_STEPS)) for n, w in weights]
    whole = sum(w for _, w in pairs)
    if min((w for _, w in pairs), default=0) < 0 or whole <= 0:
        raise ValueError(wrong)
    flat = [x for n, w in pairs for x in (F.lit(n), F.lit(Decimal(w)).cast(STEPS_TYPE))]
    return signals.withColumn("_weight", F.try_element_at(F.create_map(*flat), F.col("signal"))), F.lit(Decimal(whole))


def _steps(value: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(value.isNotNull(), F.floor(clamped * VALUE_STEPS + 0.5)).cast("decimal(10,0)")


def risk_score(
    signals: DataFrame,
    weights: DataFrame | Sequence[tuple[str, float]],
    missing: str = "skip",
    case: Sequence[str] = ("case_id",),
    cases: DataFrame | None = None,
) -> DataFrame:
    """Weighted mean per case, rounded half up to six places. `signals` holds a signal once per case.

    `missing` says what an absent signal counts as: left out of both sums, 0, or 1. `case` may carry further
    columns fixed by the case. `cases` adds cases without any signal; their score is null.
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    weighted, total = _weighted(signals, weights)
    weight = F.col("_weight")
    sums = weighted.groupBy(*case).agg(
        F.sum(weight * _steps(F.col("value"))).alias("_wv"),
        F.sum(F.when(F.col("value").isNotNull(), weight)).alias("_w"),
    )
    above, below = {
        "skip": (F.col("_wv"), F.nullif(F.col("_w"), F.lit(Decimal(0)))),
        "zero": (F.col("_wv"), total),
        "worst": (F.col("_wv") + (total - F.col("_w")) * VALUE_STEPS, total),
    }[missing]
    # Twice the quotient in millionths, plus one, halved: whole-number division rounds it half up.
    per_millionth = VALUE_STEPS // 1_000_000
    parts = sums.select(*case, (above * 2 + below * per_millionth).alias("_a"), (below * 2 * per_millionth).alias("_b"))
    scored = parts.select(*case, (F.expr("_a div _b") / F.lit(1_000_000)).alias("score"))
    if cases is None:
        return scored
    return cases.select(*case).distinct().join(scored, list(case), "left")


def decision_for(score: Column, bands: Sequence[tuple[float, float, str]]) -> Column:
    """Name of the band lo <= score < hi; the last band also takes its upper end. No score means review."""
    rows = sorted(tuple(b) for b in bands)
    decision = F.when(score.isNull(), "review")
    for n, (lo, hi, name) in enumerate(rows):
        below = score <= hi if n == len(rows) - 1 else score < hi
        decision = decision.when((score >= lo) & below, name)
    return decision


def risk_decision(
    scores: DataFrame, bands: DataFrame | Sequence[tuple[float, float, str]] = DEFAULT_BANDS
) -> DataFrame:
    """Adds `decision`. A table of bands becomes one array, made by Spark and read as a single value."""
    if not isinstance(bands, DataFrame):
        return scores.withColumn("decision", decision_for(F.col("score"), bands))
    row = F.struct(F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "decision")
    every = bands.agg(F.array_sort(F.collect_list(row)).alias("_bands")).scalar()
    score, last = F.col("score"), F.size("_bands") - 1
    held = F.filter("_bands", lambda b, i: (score >= b["lo"]) & ((score < b["hi"]) | ((i == last) & (score <= b["hi"]))))
    decision = F.when(score.isNull(), "review").otherwise(F.get(held, F.lit(0))["decision"])
    return scores.withColumn("_bands", every).withColumn("decision", decision).drop("_bands")


def top_reasons(
    signals: DataFrame,
    weights: DataFrame | Sequence[tuple[str, float]],
    k: int,
    case: Sequence[str] = ("case_id",),
) -> DataFrame:
    """The k signals that add most to each case: (case, place, signal, contribution)."""
    weighted, _ = _weighted(signals, weights)
    scaled = weighted.select(*case, "signal", (F.col("_weight") * _steps(F.col("value"))).alias("_wv"))
    millionth = VALUE_STEPS * WEIGHT_STEPS // 1_000_000
    contribution = F.expr(f"(_wv + {millionth // 2}) div {millionth}") / F.lit(1_000_000)
    ranked = Window.partitionBy(*case).orderBy(F.desc("contribution"), "signal")
    return (
        scaled.select(*case, "signal", contribution.alias("contribution"))
        .where("contribution IS NOT NULL")
        .withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= k)
        .select(*case, F.col("place").cast("bigint").alias("place"), "signal", "contribution")
    )


def review_queue(
    scores: DataFrame, per: Sequence[str], n: int, score: str = "score", case: str = "case_id"
) -> DataFrame:
    """The first n cases of each checkpoint by falling score, with place, rank and dense rank.

    The row-number filter comes first, so every task cuts its part to n rows before the shuffle; ranks of the
    rows kept do not depend on those cut.
    """
    by_place = Window.partitionBy(*per).orderBy(F.desc(score), F.col(case))
    by_score = Window.partitionBy(*per).orderBy(F.desc(score))
    kept = scores.withColumn("place", F.row_number().over(by_place)).where(F.col("place") <= n)
    return kept.select(
        *per,
        case,
        score,
        F.col("place").cast("bigint").alias("place"),
        F.rank().over(by_score).cast("bigint").alias("score_rank"),
        F.dense_rank().over(by_score).cast("bigint").alias("score_dense_rank"),
    )


def first_in_queue(scores: DataFrame, n: int, score: str = "score", case: str = "case_id") -> DataFrame:
    """The first n cases of all checkpoints together."""
    return scores.select(case, score).orderBy(F.desc(score), F.col(case)).limit(n)


def _outcomes(scores: DataFrame, labels: DataFrame, case: str) -> DataFrame:
    """Counts of positive and negative cases per distinct score: far fewer rows than cases."""
    joined = scores.join(labels.select(case, "label"), case).where("score IS NOT NULL AND label IS NOT NULL")
    return joined.groupBy("score").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"),
    )


def calibration(
    scores: DataFrame, labels: DataFrame, bins: int, case: str = "case_id", method: str = "quantile"
) -> DataFrame:
    """Cases, mean score and observed rate per bin of scores.

    `quantile`: a score's bin follows from the share of cases with a smaller score, so equal scores share a bin.
    `width`: equal parts of [0,1].
    """
    counts = _outcomes(scores, labels, case).withColumn("n", F.col("pos") + F.col("neg"))
    if method == "quantile":
        placed = cumulative(counts, "score", ["n"])
        bin_no = F.floor(F.col("below_n") * bins / F.col("total_n")) + 1
    else:
        placed = counts
        bin_no = F.least(F.floor(F.col("score") * bins) + 1, F.lit(bins))
    weighted = F.sum((F.col("score") * F.col("n")).cast("decimal(28,6)")).cast("double")
    return (
        placed.groupBy(bin_no.cast("bigint").alias("bin"))
        .agg(
            F.sum("n").alias("cases"),
            F.round(weighted / F.sum("n"), 6).alias("mean_score"),
            F.round(F.sum("pos") / F.sum("n"), 6).alias("observed_rate"),
        )
    )


def detection_quality(
    scores: DataFrame, labels: DataFrame, thresholds: DataFrame | Sequence[float], case: str = "case_id"
) -> DataFrame:
    """Confusion counts, precision, recall per threshold (score >= threshold is a hit), and rank AUC."""
    placed = _at_thresholds(_outcomes(scores, labels, case), thresholds, ["pos", "neg"])
    area = F.sum(F.col("pos").cast("decimal(38,1)") * (F.col("below_neg") + F.col("neg") / 2).cast("decimal(38,1)"))
    rows = placed.where("_mark").select(
        F.col("score").alias("threshold"),
        (F.col("total_pos") - F.col("below_pos")).alias("tp"),
        (F.col("total_neg") - F.col("below_neg")).alias("fp"),
        F.col("total_pos").alias("_p"),
        F.col("total_neg").alias("_n"),
        placed.agg(area.cast("double").alias("_area")).scalar().alias("_area"),
    )
    return rows.select(
        "threshold",
        "tp",
        "fp",
        (F.col("_n") - F.col("fp")).alias("tn"),
        (F.col("_p") - F.col("tp")).alias("fn"),
        F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6).alias("precision"),
        F.round(F.col("tp") / F.nullif(F.col("_p"), F.lit(0)), 6).alias("recall"),
        F.round(
            F.col("_area") / F.nullif(F.col("_p").cast("double") * F.col("_n").cast("double"), F.lit(0.0)), 6
        ).alias("auc"),
    )


def _at_thresholds(
    counts: DataFrame, thresholds: DataFrame | Sequence[float], measures: Sequence[str]
) -> DataFrame:
    """Counts per score with running totals; rows at a threshold have `_mark`. Thresholds go through the same pass."""
    if isinstance(thresholds, DataFrame):
        points = thresholds.select(F.col("threshold").cast("double").alias("score"))
    else:
        points = counts.sparkSession.createDataFrame([(float(t),) for t in thresholds], "score double")
    none = {m: F.lit(0).cast("bigint") for m in measures}
    rows = counts.select(F.col("score").cast("double").alias("score"), *measures, F.lit(False).alias("_mark"))
    marks = points.distinct().withColumns({**none, "_mark": F.lit(True)})
    both = rows.unionByName(marks).groupBy("score")
    folded = both.agg(*[F.sum(m).alias(m) for m in measures], F.max("_mark").alias("_mark"))
    return cumulative(folded, "score", measures)


def match_error_rates(
    scored: DataFrame, truth: DataFrame, thresholds: DataFrame | Sequence[float], keys: Sequence[str]
) -> DataFrame:
    """False match and false non-match rate per threshold. `truth`: keys, same (BOOLEAN).

    Every pair of the truth counts; one without a score is a match at no threshold.
    """
    pairs = truth.select(*keys, "same").join(scored.select(*keys, "score"), list(keys), "left").where("same IS NOT NULL")
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    # Below every threshold: where there is no score.
    low = F.coalesce(F.col("score").cast("double"), F.lit(LOWEST))
    counts = pairs.groupBy(low.alias("score")).agg(one(F.col("same")).alias("same"), one(~F.col("same")).alias("other"))
    rows = _at_thresholds(counts, thresholds, ["same", "other"]).where("_mark")
    rows = rows.select(
        F.col("score").alias("threshold"),
        (F.col("total_other") - F.col("below_other")).alias("false_matches"),
        F.col("below_same").alias("false_non_matches"),
        F.col("total_other").alias("_other"),
        F.col("total_same").alias("_same"),
    )
    return rows.select(
        "threshold",
        "false_matches",
        "false_non_matches",
        F.round(F.col("false_matches") / F.nullif(F.col("_other"), F.lit(0)), 6).alias("false_match_rate"),
        F.round(F.col("false_non_matches") / F.nullif(F.col("_same"), F.lit(0)), 6).alias("false_non_match_rate"),
    ).orderBy("threshold")
