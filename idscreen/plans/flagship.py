"""The flagship report: orders screened as cases, decisions counted per region and nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idscreen.operators.report import checkpoint_summary
from idscreen.operators.score import risk_decision, risk_score
from idscreen.sources.tables import table

WEIGHTS = [("date_order", 0.3), ("conflict", 0.3), ("listed", 0.4)]
LISTED_SEGMENT = "MACHINERY"


def case_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals per order: lines shipped before the order, line numbers with several parts, customer on the list.

    Lines are folded per (order, line, date) before they meet their order, so an order with very many lines costs
    no more than its days. The steps after that join stay partitioned by order.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber", "l_shipdate")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi")
        )
    )
    # a case whose holder is unknown is screened all the same, as not listed
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", (F.col("c_mktsegment") == LISTED_SEGMENT).alias("on_list")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customers, "o_custkey", "left")
    early = F.when(F.col("l_shipdate") < F.col("o_orderdate"), F.col("n")).otherwise(0)
    per_line = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_orderkey", "c_nationkey", "on_list", "o_orderdate", "l_linenumber")
        .agg(
            F.sum("n").alias("n"), F.sum(early).alias("early"), (F.min("lo") < F.max("hi")).alias("differs")
        )
    )
    per_case = per_line.groupBy("o_orderkey", "c_nationkey", "on_list", "o_orderdate").agg(
        (F.sum("early") / F.sum("n")).alias("date_order"),
        F.avg(F.when(F.col("differs"), 1.0).when(F.col("l_linenumber").isNotNull(), 0.0)).alias("conflict"),
    )
    signals = F.array(
        *[
            F.struct(F.lit(name).alias("signal"), value.cast("double").alias("value"))
            for name, value in (
                ("date_order", F.col("date_order")),
                ("conflict", F.col("conflict")),
                ("listed", F.coalesce("on_list", F.lit(False)).cast("int")),
            )
        ]
    )
    return per_case.select(
        F.col("o_orderkey").alias("case_id"),
        "c_nationkey",
        F.inline(signals),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("event_id"),
    ).where("value IS NOT NULL")


def case_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = ("case_id", "c_nationkey")
    # One frame that holds each signal once per case, so no latest reading has to be looked for.
    return risk_decision(risk_score(case_signals(spark, sf_dir), WEIGHTS, case=case))


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases per region, nation and decision with subtotals."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    # Counted per nation key before names are looked up: what is joined does not grow with the cases.
    counts = case_decisions(spark, sf_dir).groupBy("c_nationkey", "decision").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(nations.join(regions, "n_regionkey"), "c_nationkey", "left").fillna(
        "unknown", ["r_name", "n_name"]
    )
    return checkpoint_summary(named, ["r_name", "n_name", "decision"], count="n")
