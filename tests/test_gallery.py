"""The stored gallery index against brute force on altered copies."""

from __future__ import annotations

import numpy as np
import pytest

from idscreen.operators import gallery, vectors

SCHEMA = "vec_id bigint, embedding array<float>"


def _frame(spark, matrix, first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in v]) for k, v in enumerate(matrix)], SCHEMA)


def _altered(rng, unit, cosine):
    noise = rng.standard_normal(unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * unit + np.sqrt(1 - cosine**2) * noise


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((3_000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    path = str(tmp_path_factory.mktemp("gallery") / "index")
    gallery.create_index(_frame(spark, unit[:2_000]), path, "vec_id", "embedding")
    gallery.add_to_index(_frame(spark, unit[2_000:], 2_000), path, "vec_id", "embedding", "1")
    return path, unit


def test_altered_copies_are_found_in_few_cells(spark, stored):
    path, unit = stored
    model = gallery.read_model(spark, path)
    assert 80 <= len(model.centres) <= 100
    rng = np.random.default_rng(4)
    probes = _altered(rng, unit, 0.9)
    near = 7
    found = gallery.search_index(_frame(spark, probes), path, "vec_id", "embedding", 1, cells=near).collect()
    hits = {r.probe_id for r in found if r.gallery_id == r.probe_id}
    assert len(hits) >= 0.95 * len(unit)
    for half in (range(2_000), range(2_000, 3_000)):  # the added batch is found as well as the first
        assert len(hits & set(half)) >= 0.95 * len(half)
    assert all(abs(r.cosine - 0.9) < 1e-5 for r in found if r.gallery_id == r.probe_id)
    # rows looked at: a tenth of all pairs at most
    sizes = np.bincount(model.place(unit)[0], minlength=len(model.centres))
    looked_at = sizes[model.cells_near(probes / np.linalg.norm(probes, axis=1, keepdims=True), near)].sum()
    assert looked_at <= 0.1 * len(unit) ** 2


def test_all_cells_and_rows_equal_brute_force(spark, stored):
    path, unit = stored
    probes = _frame(spark, unit[:40] + 0.1)
    got = gallery.search_index(probes, path, "vec_id", "embedding", 3, cells=10_000, rerank=10_000, exclude_self=True, block_rows=300)
    want = vectors.match_one_to_many(probes, _frame(spark, unit), "vec_id", "embedding", 3)
    assert sorted((r.probe_id, r.gallery_id, r.place) for r in got.collect()) == sorted((r.probe_id, r.gallery_id, r.place) for r in want.collect())


def test_a_batch_replaces_itself(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((30, 10))
    path = str(tmp_path / "index")
    gallery.create_index(_frame(spark, rows), path, "vec_id", "embedding", parts=3)
    for _ in range(2):
        gallery.add_to_index(_frame(spark, rows[:5], 100), path, "vec_id", "embedding", "a/b")
    odd = spark.createDataFrame([(200, None), (201, [0.0] * 10), (202, [1.0] * 10)], SCHEMA)
    gallery.add_to_index(odd, path, "vec_id", "embedding", "odd")
    assert gallery.read_index(spark, path).count() == 36
    found = gallery.search_index(_frame(spark, rows[:1]), path, "vec_id", "embedding", 2, cells=99).collect()
    assert [(r.gallery_id, r.cosine, r.place) for r in sorted(found, key=lambda r: r.place)] == [(0, 1.0, 1), (100, 1.0, 2)]
    nothing = gallery.search_index(_frame(spark, rows[:0]), path, "vec_id", "embedding", 2)
    assert nothing.count() == 0


def test_copies_in_one_cell_are_cut_into_blocks(spark, tmp_path):
    path = str(tmp_path / "index")
    same = np.tile(np.arange(1, 9, dtype=float), (500, 1))
    gallery.create_index(_frame(spark, same), path, "vec_id", "embedding", parts=2)
    found = gallery.search_index(_frame(spark, same[:3]), path, "vec_id", "embedding", 2, cells=3, rerank=500, block_rows=50)
    assert {(r.probe_id, r.gallery_id, r.place) for r in found.collect()} == {(p, g, g + 1) for p in range(3) for g in (0, 1)}
