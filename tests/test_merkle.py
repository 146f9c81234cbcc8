"""The digest tree over trails: which rows changed, and proofs that a row is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from idscreen.operators import merkle

SCHEMA = "case_id string, seq bigint, actor string, payload string"


def _trail(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _rows(sizes):
    return [(c, k, "a" if k % 3 else None, f"step {k}") for c, n in sizes.items() for k in range(n)]


def _tree(spark, rows, fanout=4):
    return merkle.trail_tree(_trail(spark, rows), "case_id", "seq", fanout=fanout)


def _changes(then, now, fanout=4):
    return sorted(map(tuple, merkle.tree_changes(then, now, "case_id", fanout).collect()), key=repr)


def test_levels_follow_each_case(spark):
    tree = _tree(spark, _rows({"one": 1, "five": 5, "long": 70})).collect()
    heights = {c: max(r.level for r in tree if r.case_id == c) for c in ("one", "five", "long")}
    assert heights == {"one": 0, "five": 2, "long": 4}
    for case, n in {"one": 1, "five": 5, "long": 70}.items():
        root = [r for r in tree if r.case_id == case and r.level == heights[case]]
        assert len(root) == 1 and root[0].rows == n and root[0].node == 0


def test_changes_name_rows(spark):
    sizes = {"one": 1, "five": 5, "long": 70, "same": 33, "gone": 3, None: 6}
    rows = _rows(sizes)
    edited = [r for r in rows if r[0] != "gone" and r != ("long", 40, "a", "step 40")]
    edited = [(c, k, a, "other") if (c, k) in {("one", 0), ("long", 17), (None, 2)} else (c, k, a, p) for c, k, a, p in edited]
    edited += [("long", 70, "a", "more"), ("long", 400, "a", "far"), ("five", 5, None, "x"), ("new", 2, "a", "b"), ("five", 3, "a", "again")]
    want = {("one", 0, "changed"), ("long", 17, "changed"), (None, 2, "changed"), ("long", 40, "missing"), ("long", 70, "extra")}
    want |= {("long", 400, "extra"), ("five", 5, "extra"), ("five", 3, "changed"), ("new", 2, "extra")}
    want |= {("gone", k, "missing") for k in range(3)}
    assert _changes(_tree(spark, rows), _tree(spark, edited)) == sorted(want, key=repr)
    assert _changes(_tree(spark, rows), _tree(spark, list(reversed(rows)))) == []
    assert _changes(_tree(spark, []), _tree(spark, rows[:1])) == [("one", 0, "extra")]
    assert _changes(_tree(spark, []), _tree(spark, [])) == []


def test_values_cannot_move_between_places(spark):
    a = [("c", 0, "x", "1"), ("c", 1, "x", "2")]
    b = [("c", 0, "x", "2"), ("c", 1, "x", "1")]
    assert _changes(_tree(spark, a), _tree(spark, b)) == [("c", 0, "changed"), ("c", 1, "changed")]


def test_proofs_of_cases_of_different_height(spark):
    rows = _rows({"one": 1, "four": 4, "five": 5, "long": 70, None: 3})
    tree, leaves = _tree(spark, rows), merkle.trail_leaves(_trail(spark, rows), "case_id", "seq")
    roots = tree.groupBy("case_id").agg(F.max_by("digest", "level").alias("digest"))
    proofs = merkle.inclusion_proofs(tree, leaves, "case_id", 4)
    told = merkle.proven(proofs, leaves, roots, "case_id", 4).collect()
    assert len(told) == len(rows) and all(r.holds for r in told)
    moved = leaves.withColumn("node", F.col("node") + 1)
    assert not any(r.holds for r in merkle.proven(proofs, moved, roots, "case_id", 4).collect())


def test_written_tree_and_few_digests_read(spark, tmp_path):
    n, fanout = 100_000, 32
    base = spark.range(n).select(F.lit("big").alias("case_id"), F.col("id").alias("seq"), F.lit("a").alias("actor"), F.col("id").cast("string").alias("payload"))
    merkle.write_tree(merkle.trail_tree(base, "case_id", "seq", fanout=fanout), str(tmp_path / "tree"), "case_id")
    stored = merkle.read_tree(spark, str(tmp_path / "tree"), "case_id", "string")
    edited = base.withColumn("payload", F.when(F.col("seq") == 77_777, "forged").otherwise(F.col("payload")))
    now = merkle.trail_tree(edited, "case_id", "seq", fanout=fanout)
    assert _changes(stored, now, fanout) == [("big", 77_777, "changed")]
    proofs = merkle.inclusion_proofs(stored, spark.createDataFrame([("big", 77_777), ("big", 0), ("big", n - 1)], "case_id string, node bigint"), "case_id", fanout)
    assert proofs.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 4 * fanout
    roots = stored.groupBy("case_id").agg(F.max_by("digest", "level").alias("digest"))
    honest = merkle.trail_leaves(base, "case_id", "seq").where(F.col("node").isin(0, 77_777, n - 1))
    assert {r.leaf: r.holds for r in merkle.proven(proofs, honest, roots, "case_id", fanout).collect()} == {0: True, 77_777: True, n - 1: True}
    forged = merkle.trail_leaves(edited, "case_id", "seq").where(F.col("node").isin(0, 77_777, 5))
    assert {r.leaf: r.holds for r in merkle.proven(proofs, forged, roots, "case_id", fanout).collect()} == {0: True, 77_777: False, 5: False}
