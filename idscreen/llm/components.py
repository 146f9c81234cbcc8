"""Connected components of a link table, by rounds of joins that never gather a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idscreen.llm.shared import materialise


def _lowest(links: DataFrame) -> DataFrame:
    """(b, m): every node's smallest neighbour below it. Folded in every task before the shuffle."""
    return links.groupBy("b").agg(F.min("a").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours, linked to the smallest of its neighbours and itself instead.

    Links have a < b, and only neighbours below a node can be smaller than it, so neither star needs links both ways.
    Neighbours meet the minimum by a join, so a node with very many of them is never one group in memory.
    """
    low = _lowest(links).withColumnRenamed("b", "a")
    return links.join(low, "a", "left").select(F.coalesce("m", "a").alias("a"), "b")


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours, linked to the smallest of them."""
    low = _lowest(links)
    moved = links.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(low.select(F.col("m").alias("a"), "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it is linked to, over any way.

    Alternating large and small stars (Kiveris et al. 2014) until nothing changes; the number of rounds grows with the
    logarithm of the longest way. Every round is written in the shared folder. One row per round is read by the
    driver.
    """
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    now = materialise(order(links), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(now)
    while before[0]:
        now = materialise(_small_star(_large_star(now)).distinct(), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
