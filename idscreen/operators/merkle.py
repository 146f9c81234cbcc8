"""A digest tree over each case's trail, which names the rows that were changed and proves that a row is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idscreen.functions import digest as dg
from idscreen.sources.scratch import shared_dir

FANOUT = 64
SCHEMA = "level INT, node BIGINT, digest STRING, rows BIGINT"


def _node_digest(children: Column) -> Column:
    """Digest of (place, digest) pairs in order of place, each with its place, so that children cannot change places."""
    texts = F.transform(F.array_sort(children), lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"]))
    return F.sha2(F.array_join(texts, ";"), 256)


def trail_leaves(events: DataFrame, case: str, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(case, level 0, node, digest, rows): one leaf for every value of `order` in a case.

    `order` is a sequence number of the case: a whole number, not null and not negative. Rows that share one are one leaf over
    their sorted digests.
    """
    rows = events.where(F.col(order) >= 0).select(
        case, F.col(order).cast("bigint").alias("node"), F.sha2(dg.row_text(list(columns or events.columns)), 256).alias("digest")
    )
    single = F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ";"), 256)
    return rows.groupBy(case, "node").agg(single.alias("digest"), F.count(F.lit(1)).alias("rows")).select(
        case, F.lit(0).alias("level"), "node", "digest", "rows"
    )


def trail_tree(
    events: DataFrame, case: str, order: str, columns: Sequence[str] | None = None, fanout: int = FANOUT
) -> DataFrame:
    """(case, level, node, digest, rows) of every node; node k of a level covers nodes k * fanout to k * fanout + fanout - 1
    of the level below.

    A case has as many levels as its own highest sequence number needs, and its root is the node 0 of its highest level. No group is
    ever larger than `fanout` digests. Every level is written before the next is made from it. The driver reads one number, the highest
    sequence number of all.
    """
    shared_dir(events.sparkSession)
    level = trail_leaves(events, case, order, columns).checkpoint()
    tree, highest = level, level.agg(F.max("node")).first()[0]
    number = 0
    while highest is not None and highest > 0:
        highest //= fanout
        number += 1
        below = level
        # a case whose level below is its root already goes no higher
        tops = below.groupBy(case).agg(F.max("node").alias("_top")).where("_top > 0").select(F.col(case).alias("_case"))
        going = below.join(tops, below[case].eqNullSafe(F.col("_case")), "left_semi")
        level = (
            going.groupBy(case, F.floor(F.col("node") / fanout).cast("bigint").alias("_up"))
            .agg(_node_digest(F.collect_list(F.struct("node", "digest"))).alias("digest"), F.sum("rows").alias("rows"))
            .select(case, F.lit(number).alias("level"), F.col("_up").alias("node"), "digest", "rows")
        ).checkpoint()
        tree = tree.unionByName(level)
    return tree


def write_tree(tree: DataFrame, path: str, case: str) -> None:
    """A folder for each level, its rows in order of case and node, so that a reader of few nodes skips the rest."""
    ordered = tree.repartitionByRange("level", case, "node").sortWithinPartitions("level", case, "node")
    ordered.write.mode("errorifexists").partitionBy("level").parquet(path)


def read_tree(spark, path: str, case: str, case_type: str) -> DataFrame:
    return spark.read.schema(f"{case} {case_type}, node BIGINT, digest STRING, rows BIGINT, level INT").parquet(path)


def _height(tree: DataFrame) -> int:
    return tree.agg(F.max("level")).first()[0] or 0


def _roots(tree: DataFrame, case: str) -> DataFrame:
    return tree.groupBy(case).agg(F.max_by(F.struct("level", "node", "digest"), "level").alias("root"))


def tree_changes(then: DataFrame, now: DataFrame, case: str, fanout: int = FANOUT) -> DataFrame:
    """The rows that differ between two trees: (case, node, status), status changed, missing (gone) or extra (new).

    The descent starts at the cases whose roots differ and goes down only below nodes that differ, so of a case with one edit
    it meets `fanout` digests a level. Trees of different height are compared from the lower one's height on; where the
    higher one has other nodes on that level, those differ.
    """
    shared_dir(then.sparkSession)
    a, b = _roots(then, case), _roots(now, case).withColumnsRenamed({case: "_case", "root": "root_now"})
    met = a.join(b, a[case].eqNullSafe(F.col("_case")), "full_outer")
    differing = met.where(~F.col("root").eqNullSafe(F.col("root_now"))).select(
        F.coalesce(case, "_case").alias(case),
        F.coalesce(F.least("root.level", "root_now.level"), F.lit(0)).alias("_from"),
    ).checkpoint()
    found = None
    pending: DataFrame | None = None
    for level in range(max(_height(then), _height(now)), -1, -1):
        starting = differing.where(F.col("_from") == level).select(F.col(case).alias("_case"))

        def wanted(tree: DataFrame) -> DataFrame:
            nodes = tree.where(F.col("level") == level)
            first = nodes.join(starting, nodes[case].eqNullSafe(F.col("_case")), "left_semi")
            if pending is None:
                return first
            up = pending.select(F.col(case).alias("_case"), F.col("node").alias("_node"))
            below = nodes.join(
                up, nodes[case].eqNullSafe(F.col("_case")) & (F.floor(F.col("node") / fanout) == F.col("_node")), "left_semi"
            )
            return first.unionByName(below)

        old = wanted(then).select(case, "node", F.col("digest").alias("_then"))
        new = wanted(now).select(F.col(case).alias("_case"), F.col("node").alias("_node"), F.col("digest").alias("_now"))
        both = old.join(new, old[case].eqNullSafe(F.col("_case")) & (F.col("node") == F.col("_node")), "full_outer")
        pending = both.where(~F.col("_then").eqNullSafe(F.col("_now"))).select(
            F.when(F.col("node").isNull(), F.col("_case")).otherwise(F.col(case)).alias(case),
            F.coalesce("node", "_node").alias("node"),
            F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "extra").otherwise("changed").alias("status"),
        ).checkpoint()
        found = pending
    return found


def inclusion_proofs(tree: DataFrame, wanted: DataFrame, case: str, fanout: int = FANOUT) -> DataFrame:
    """(case, leaf, level, node, digest) for every wanted (case, node): the children, on every level, of the node above the leaf.

    With these, the leaf's own digest and the root, `proven` can tell that the row was in the trail, without the trail.
    """
    asked = wanted.select(F.col(case).alias("_case"), F.col("node").alias("leaf")).distinct()
    levels = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(0, _height(tree) - 1)))).alias("_level"))
    step = F.pow(F.lit(float(fanout)), F.col("_level") + 1)
    placed = levels.withColumn("_up", F.floor(F.col("leaf") / step).cast("bigint"))
    above = F.floor(F.col("node") / fanout).cast("bigint")
    tops = tree.groupBy(case).agg(F.max("level").alias("_top")).withColumnRenamed(case, "_top_case")
    nodes = tree.join(tops, tree[case].eqNullSafe(F.col("_top_case"))).where("level < _top").withColumn("_parent", above)
    same = nodes[case].eqNullSafe(F.col("_case")) & (F.col("level") == F.col("_level")) & (F.col("_parent") == F.col("_up"))
    return nodes.join(placed, same).select(case, "leaf", "level", "node", "digest")


def proven(proofs: DataFrame, leaves: DataFrame, roots: DataFrame, case: str, fanout: int = FANOUT) -> DataFrame:
    """(case, leaf, holds): whether the claimed leaf digests (case, node, digest) and their proofs lead to the roots
    (case, digest).

    On every level the digest made so far must be the child that the proof names; the digest of all children is the next one.
    """
    step = proofs.groupBy(case, "leaf", "level").agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("children"))
    path = step.groupBy(case, "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "children"))).alias("path"))
    claimed = leaves.select(F.col(case).alias("_case"), F.col("node").alias("_leaf"), F.col("digest").alias("_claimed"))
    ends = roots.select(F.col(case).alias("_root_case"), F.col("digest").alias("_root"))

    def climb(so_far: Column, level: Column) -> Column:
        named = F.exists(level["children"], lambda c: (c["node"] == so_far["node"]) & (c["digest"] == so_far["digest"]))
        texts = F.transform(level["children"], lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"]))
        up = F.floor(so_far["node"] / fanout).cast("bigint")
        return F.struct(up.alias("node"), F.when(named, F.sha2(F.array_join(texts, ";"), 256)).alias("digest"))

    met = claimed.join(path, path[case].eqNullSafe(F.col("_case")) & (F.col("leaf") == F.col("_leaf")), "left")
    met = met.join(ends, F.col("_case").eqNullSafe(F.col("_root_case")), "left")
    start = F.struct(F.col("_leaf").alias("node"), F.col("_claimed").alias("digest"))
    steps = F.coalesce("path", F.array().cast("array<struct<level:int,children:array<struct<node:bigint,digest:string>>>>"))
    # the way up must end at the root's own place, which a trail of one row tells by nothing else
    top = F.aggregate(steps, start, climb, lambda s: F.when(s["node"] == 0, s["digest"]))
    return met.select(F.col("_case").alias(case), F.col("_leaf").alias("leaf"), F.coalesce(top == F.col("_root"), F.lit(False)).alias("holds"))
