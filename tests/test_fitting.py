"""Fitted models and sequential folds, against small loops."""

import numpy as np
import pytest

from tidemark.operators import fitting


def sequence(n=160):
    rng = np.random.default_rng(4)
    return [(k % 2, k, float(rng.integers(0, 256) if rng.random() < 0.1 else 100 + rng.integers(-9, 9))) for k in range(n)]


def test_scene_breaks_against_a_loop(spark):
    rows = sequence()
    got = {r.id: (round(r.residual, 9), r.broke) for r in fitting.scene_breaks(spark.createDataFrame(rows, "device long, id long, gm double"), "device", ["id"], "gm").collect()}
    want = {}
    for device in (0, 1):
        level = quick = None
        for _, i, x in [r for r in rows if r[0] == device]:
            gap = 0.0 if level is None else abs(x - level)
            new = level is None or gap > 30
            want[i] = (round(gap, 9), new)
            if new:
                level, quick = x, 7
            elif quick > 0:
                level, quick = level + 0.5 * (x - level), quick - 1
            else:
                level = level + 0.15 * (x - level)
    assert got == want and sum(b for _, b in want.values()) > 4


def test_regimes_are_found_joined_and_merged(spark):
    points = [(0.0, 0.0), (0.05, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.02, 0.01), (1.01, 0.0), (2.0, 2.0), (2.0, 2.02)]
    rows = [(1, k, list(p)) for k, p in enumerate(points)]
    got = sorted(fitting.regime_bank(spark.createDataFrame(rows, "device long, id long, d array<double>"), "device", ["id"], "d", near=0.2, most=4).collect())
    assert [r.regime for r in got] == [0, 0, 1, 2, 3, 0, 1, 4, 4]
    assert [r.regimes for r in got] == [1, 1, 2, 3, 4, 4, 4, 5, 4]  # five before the two closest merge
    assert got[1].distance == pytest.approx(0.05) and got[5].distance == pytest.approx(np.hypot(0.02 - 0.025, 0.01)) and got[0].distance == float("inf")


def test_clusters_are_ordered_by_brightness(spark):
    rng = np.random.default_rng(2)
    centres = [200.0, 20.0, 120.0, 70.0]
    rows = [(k, (centres[k % 4] + rng.normal(0, 2, 6)).tolist()) for k in range(80)]
    got = fitting.clustered(spark.createDataFrame(rows, "id long, v array<double>"), "v", 4, starts=3).collect()
    assert {(r.id % 4, r.cluster) for r in got} == {(0, 3), (1, 0), (2, 2), (3, 1)}


def test_components_are_those_of_the_svd(spark):
    x = np.random.default_rng(5).normal(size=(60, 5)) * np.array([9, 4, 2, 1, 0.5])
    got = sorted(fitting.projected(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>"), "v", 2).collect())
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([r.components for r in got]), np.abs(x @ axes[:2].T), atol=1e-6)


def test_folds_never_see_their_group_and_trees_learn(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(k // 20), float(a), float(b), float(a > 0.5)) for k, (a, b) in enumerate(rng.random((200, 2)))]
    frame = spark.createDataFrame(rows, "id long, day long, a double, b double, y double")
    c = fitting.BoostConfig(rounds=20, rate=0.3, least_rows=5)
    got = fitting.out_of_fold(frame, ["a", "b"], "y", "day", 3, c).toPandas()
    assert len(got) == 200 and got.groupby("day").fold.nunique().max() == 1
    assert ((got.score > 0.5) == (got.y > 0.5)).mean() > 0.95
    random = frame.selectExpr("id", "day", "b AS a", "b", "CAST(hash(id) % 2 = 0 AS DOUBLE) AS y")
    noise = fitting.out_of_fold(random, ["a", "b"], "y", "day", 3, c).toPandas()
    assert ((noise.score > 0.5) == (noise.y > 0.5)).mean() < 0.75


def test_synthetic_frames_shift_all_cells_alike(spark):
    from tidemark import registry

    one, two = (sorted(registry.queries()["synthetic_frames"](spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert one == two
    source = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    for r in one:
        shifts = [x - (128 + 200 * e) for x, e in zip(r.tile, source[r.vec_id], strict=True) if 0 < x < 255]
        assert np.ptp(shifts) < 1e-4 and -20 <= shifts[0] <= 20
