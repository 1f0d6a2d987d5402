"""The metric index against all pairs, and how many pairs it tests; models of what it finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieval


def all_pairs(rows, k, lag):
    """(id, match, distance, place) by testing every pair."""
    out = set()
    for block in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == block and None not in r[1:] and None not in r[3]]
        if not own:
            continue
        v, o, ids = np.array([r[3] for r in own], dtype=float), np.array([r[1] for r in own]), np.array([r[2] for r in own])
        for i, r in enumerate(own):
            at = np.flatnonzero(o <= r[1] - lag)
            d = np.sqrt(((v[at] - v[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[at], d))[:k]
            out |= {(r[2], int(ids[at][m]), round(float(d[m]), 9), place + 1) for place, m in enumerate(order)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "block int, at long, id long, v array<double>, b string").repartition(5)


@pytest.mark.parametrize("size, pivots, lag", [(8, 3, 1), (16, 16, 40), (1024, 1, 1)])
def test_matches_are_those_of_all_pairs(spark, size, pivots, lag):
    """Ties, repeated vectors, equal orders, a null block, rows with nulls, blocks of one row, a hot block and clashing names."""
    rng = np.random.default_rng(size)
    rows = [(None if k % 11 == 0 else 1 if k % 3 else k % 5, int(rng.integers(0, 300)), k, [float(x) for x in rng.integers(0, 6, 3)], "x") for k in range(600)]
    rows += [(77, 1, 1000, [1.0, 2.0, 3.0], "x"), (1, None, 1001, [1.0, 2.0, 3.0], "x"), (1, 5, 1002, None, "x"), (1, 5, 1003, [None, 2.0, 3.0], "x"), (1, 5, None, [1.0, 2.0, 3.0], "x")]
    index = retrieval.Index(frame(spark, rows), "v", ["block"], "at", "id", 4, lag, size, pivots)
    got = {(r.id, r.match, round(r.distance, 9), r.place) for r in index.matches().collect()}
    assert got == all_pairs(rows, 4, lag)


def test_few_pairs_are_tested(spark):
    rng = np.random.default_rng(1)
    centres = rng.uniform(0, 1000, (40, 3))
    v = centres[rng.integers(0, 40, 12000)] + rng.normal(0, 5, (12000, 3))
    rows = [(0, k, k, [float(x) for x in v[k]], "x") for k in range(12000)]
    index = retrieval.Index(frame(spark, rows), "v", ["block"], "at", "id", 3, size=1024, pivots=32)
    later = index.planned.agg(F.sum("rows")).first()[0]
    assert later < 0.15 * 12000 * 12000 / 2
    got = index.matches().where("id % 97 = 0").collect()
    found = {}
    for r in got:
        found.setdefault(r.id, []).append((r.place, r.match))
    for i in range(97, 12000, 97):
        d = np.sqrt(((v[:i] - v[i]) ** 2).sum(axis=1))
        assert [m for _, m in sorted(found[i])] == list(np.lexsort((np.arange(i), d))[:3])


def test_an_empty_table_and_equal_vectors(spark):
    assert retrieval.nearest_past(frame(spark, []), "v", ["block"], "at", "id", 3).count() == 0
    rows = [(0, k, k, [1.0, 1.0], "x") for k in range(40)]
    index = retrieval.Index(frame(spark, rows), "v", ["block"], "at", "id", 2, size=8)
    assert {(r.id, r.match) for r in index.matches().collect()} == {(k, m) for k in range(40) for m in range(min(2, k))}


def test_a_group_of_copies_makes_no_pairs_of_its_own(spark):
    rows = [(0, k, k, [1.0, 1.0] if k % 8 else [float(k), 2.0], "x") for k in range(4000)]
    index = retrieval.Index(frame(spark, rows), "v", ["block"], "at", "id", 2, size=64)
    assert index.planned.agg(F.sum("rows")).first()[0] < 0.05 * 4000 * 4000
    assert {(r.id, r.match, round(r.distance, 9), r.place) for r in index.matches().collect()} == all_pairs(rows, 2, 1)


def test_medians_and_deviations_of_what_is_found(spark):
    rng = np.random.default_rng(2)
    tiles = {k: [float(x) for x in rng.integers(0, 50, 6)] for k in range(9)}
    pairs = [(1, 2), (1, 3), (1, 4), (1, 5), (2, 6), (2, 7), (3, 8)]
    matches = spark.createDataFrame(pairs, "id long, match long")
    grids = spark.createDataFrame(list(tiles.items()), "id long, tile array<double>")
    got = {r.id: r for r in retrieval.retrieved(matches, grids, "id", "tile", 6).collect()}
    for i in (1, 2, 3):
        held = np.array([tiles[m] for a, m in pairs if a == i])
        median = np.median(held, axis=0)
        assert got[i].members == len(held) and np.allclose(got[i]["median"], median) and np.allclose(got[i].mad, 1.4826 * np.median(np.abs(held - median), axis=0))


@pytest.mark.parametrize("size, pivots", [(16, 8), (1024, 4)])
def test_rounded_distances_are_compared(spark, size, pivots):
    """With digits, of matches that agree in them the smaller ids are nearer, as in SQL that ranks by rounded distances."""
    rng = np.random.default_rng(3)
    rows = [(k % 2, k, int(i), [float(x) for x in rng.uniform(0, 3, 2)], "x") for k, i in enumerate(rng.permutation(400))]
    rows += [(k % 2, 400 + k, 1000 + k, rows[k][3], "x") for k in range(0, 60)]
    found = retrieval.Index(frame(spark, rows), "v", ["block"], "at", "id", 4, 1, size, pivots, digits=1).matches().collect()
    want = set()
    for block, at, i, v, _ in rows:
        near = sorted((float(np.floor(np.hypot(v[0] - r[3][0], v[1] - r[3][1]) * 10 + 0.5) / 10), r[2]) for r in rows if r[0] == block and r[1] < at)
        want |= {(i, m, d, place + 1) for place, (d, m) in enumerate(near[:4])}
    assert {(r.id, r.match, r.distance, r.place) for r in found} == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_travel_by_units(spark, kind):
    """Where pivots rule out nothing, pairs of units are planned, not pairs of cells with the vectors of both in each."""
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (1500, 24)).astype(np.float32)
    rows = [(k % 2, k, k, [float(x) for x in v[k]], "x") for k in range(1500)]
    table = frame(spark, rows).withColumn("v", F.col("v").cast(f"array<{kind}>"))
    index = retrieval.Index(table, "v", ["block"], "at", "id", 4, size=16, pivots=8)
    assert index.planned.agg(F.sum("rows")).first()[0] > 0.8 * 2 * 750 * 750 / 2
    assert index.planned.count() <= 2 * 8 * 9 / 2
    assert {(r.id, r.match, round(r.distance, 9), r.place) for r in index.matches().collect()} == all_pairs(rows, 4, 1)


def test_rows_close_beside_the_farthest(spark):
    """32-bit products can't part vectors a millionth of the farthest norm from each other."""
    rng = np.random.default_rng(5)
    rows = [(0, k, k, [1e6 + float(x) for x in rng.integers(0, 9, 3)], "x") for k in range(400)]
    rows += [(0, 400 + k, 400 + k, [float(x) for x in rng.uniform(-1e9, 1e9, 3)], "x") for k in range(5)]
    index = retrieval.Index(frame(spark, rows), "v", ["block"], "at", "id", 3, size=16, pivots=4)
    want = {(i, m, place) for i, m, _, place in all_pairs(rows, 3, 1)}
    assert {(r.id, r.match, r.place) for r in index.matches().collect()} == want
