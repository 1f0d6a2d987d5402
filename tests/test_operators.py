"""Edges of single operators, against small loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import cascades, filters, fitting, grid, lookups, sequence, suppression
from tidemark.sources import binary


@pytest.mark.parametrize("value, expected", [(-1.0, 0), (0.0, 1), (4.999, 1), (5.0, 2), (50.0, 7), (90.0, 7)])
def test_band_edges_are_inclusive(spark, value, expected):
    assert spark.range(1).select(suppression.band(F.lit(value), suppression.ELEVATION_EDGES)).first()[0] == expected


def test_score_outside_of_the_table(spark):
    got = spark.createDataFrame([(0,), (191,), (192,), (None,)], "c int").select(suppression.score_of(F.col("c"))).collect()
    assert [r[0] for r in got] == [13, 116, 255, 255]


def test_bursts_at_the_limit_and_backwards(spark):
    rows = [(1, 7, 0), (2, 7, 59_000_000), (3, 7, 119_000_000), (4, 7, 120_000_000), (5, 7, 120_000_000)]
    got = sequence.with_burst_position(spark.createDataFrame(rows, "id int, device int, us long")).orderBy("id").collect()
    assert [r.burst_pos for r in got] == [0, 1, 0, 1, 2]
    assert got[0].quiet_gap == sequence.UNKNOWN_GAP


def test_decision_without_a_clock(spark):
    rows = [(1, 7, 0, "pir"), (2, 7, 10, "rtc"), (3, 7, 20, None)]
    frame = spark.createDataFrame(rows, "id int, device int, us long, source string").withColumn("captured_at", F.timestamp_micros("us"))
    got = {r.id: (r.why, r.score, r.suppress) for r in suppression.decide(frame).collect()}
    assert got == {1: ("NO_TIME", 255, False), 2: ("RTC", 255, False), 3: ("RTC", 255, False)}


def test_none_and_missing_results(spark):
    rows = [(1, None, "process"), (2, None, None), (3, "bird", None), (4, None, "batched")]
    frame = spark.createDataFrame(rows, "id int, label string, result string")
    pick = lambda active, **kw: [r.id for r in frame.where(filters.label_filter(active, **kw)).orderBy("id").collect()]
    assert pick({"none"}) == [1]
    assert pick({"none"}, batched=False) == [1, 4]
    assert pick({"bird"}) == [3]
    assert pick(set()) == []
    assert pick({"cloud", "none", "batched", *filters.LABELS}) == [1, 2, 3, 4]


def flood(mask, h, w, diagonal):
    sizes, seen = [], set()
    for start in range(h * w):
        if mask[start] and start not in seen:
            stack, n = [start], 0
            seen.add(start)
            while stack:
                k = stack.pop()
                n += 1
                for j in grid.neighbours(h, w, diagonal)[k]:
                    if mask[j] and j not in seen:
                        seen.add(j)
                        stack.append(j)
            sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("diagonal", [False, True])
def test_blobs_against_a_flood_fill(spark, diagonal):
    rng = random.Random(3)
    spiral = "11111110" "00000010" "11111010" "10001010" "10111010" "10000010" "11111110" "00000000"
    masks = [[c == "1" for c in spiral], [False] * 64, [True] * 64, *([rng.random() < 0.5 for _ in range(64)] for _ in range(40))]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "id int, mask array<boolean>")
    got = frame.select("id", grid.blob_sizes(grid.components(F.col("mask"), 8, 8, diagonal)).alias("s")).collect()
    assert {r.id: sorted(r.s) for r in got} == {i: flood(m, 8, 8, diagonal) for i, m in enumerate(masks)}


def test_constant_model_fits_nothing(spark):
    frame = spark.createDataFrame([([100.0] * 64, [50.0] * 64)], "m array<double>, t array<double>")
    fit = frame.select(grid.trimmed_line(F.col("m"), F.col("t"), 20.0, 10, 1.0).alias("l")).first().l
    assert (fit.a, fit.b) == (1.0, 0.0)


def test_as_of_is_strict_about_the_lag(spark):
    left = spark.createDataFrame([(1, 7, 100), (2, 7, 159), (3, 7, 160), (4, 8, 500)], "id int, device int, us long")
    right = spark.createDataFrame([(9, 7, 100)], "rid int, device int, us long")
    got = {r.id: r.found for r in lookups.as_of(left, right, "device", "us", ["rid"], 60).collect()}
    assert got[1] is None and got[2] is None and got[4] is None and got[3].rid == 9


@pytest.mark.parametrize(
    "row, expected",
    [
        ((None, None, 100, None, 0, 0, 0), "FIRST"), ((100, 181.0, 100, 0, 0, 0, 0), "ISOLATED"), ((100, 180.0, 130, 30, 9, 0, 0), "BRIGHTNESS_SHIFT"),
        ((100, 14.0, 130, 30, 9, 0, 0), "FAST_SHIFT"), ((100, 15.0, 100, 12, 0, 0, 0), "DUPLICATE"), ((170, 15.0, 161, 9, 1, 34, 0), "BRIGHT_STABLE"),
        ((170, 15.0, 161, 9, 1, 60, 0), "DIFFUSE"), ((60, 15.0, 69, 9, 1, 60, 0), "NIGHT"), ((100, 15.0, 100, 0, 0, 59, 1), "SAFE"),
    ],
)
def test_burst_cascade_edges(spark, row, expected):
    frame = spark.createDataFrame([row], "prev_gm int, dt double, gm int, gm_diff int, n_changed int, n_dark int, n_chroma int")
    assert frame.select(cascades.burst_filter()["trigger"]).first()[0] == expected


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    h = 2166136261
    for b in b"v1.2":
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    assert one(scalars.fnv1a(F.lit("v1.2"))) == h
    assert one(scalars.human_time(F.lit(90061))) == "1d 1h"
    assert one(scalars.stamp_in_name(F.lit("20261301_000000.jpg"))) is None


def test_cut_records(spark):
    raw = binary.framed('{"a": 1}', b"xyz") + binary.framed('{"a": 2}', b"") + b"\xff\xff\xff\xff\0\0\0\0"
    got = binary.records(spark.createDataFrame([("p", bytearray(raw)), ("q", bytearray(b""))], "path string, content binary")).collect()
    assert [(r.path, r.place, r.meta, r.size) for r in got] == [("p", 0, '{"a": 1}', 3), ("p", 1, '{"a": 2}', 0)]


def test_phase_shift_finds_a_roll():
    a = np.random.default_rng(0).normal(size=(32, 32))
    dy, dx, _ = fitting.phase_shift(np.roll(a, (3, -2), (0, 1)), a)
    assert round(dy) == 3 and round(dx) == -2


@pytest.mark.parametrize("values", [[], [3.0], list(range(1, 500)), [None, -1.5, 0.0, float("inf")], [1e9 * k for k in range(70)]])
def test_running_sums_over_ranges(spark, values):
    from tidemark.operators import evaluation

    rows = [(None if v is None else float(v), k % 7, 1) for k, v in enumerate(values)]
    got = evaluation.running_sums(spark.createDataFrame(rows, "v double, a long, b long"), "v", ["a", "b"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {r[0]: (sum(x[1] for x in order[:k]), k, sum(x[1] for x in order), len(order)) for k, r in enumerate(order)}
    assert {r.v: (r.before_a, r.before_b, r.all_a, r.all_b) for r in got} == want


def test_nearest_by_rounded_distances(spark):
    """Of models whose distances agree in the places that are compared, the smaller key is nearest."""
    models = spark.createDataFrame([(1, [1.0 + 4e-7, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0])], "k int, v array<double>")
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.5, 0.0])], "id int, x array<double>")
    found = {r.id: (r.nearest.k, r.nearest.d) for r in lookups.nearest(rows, models, "x", "v", "k", digits=6).collect()}
    assert found == {1: (1, 1.0), 2: (3, 0.0)}
    assert {r.id: r.nearest.k for r in lookups.nearest(rows, models, "x", "v", "k").collect()} == {1: 1, 2: 3}
    mirrored = spark.createDataFrame([(1, [1.0 - 4e-7, 0.0]), (2, [1.0, 0.0])], "k int, v array<double>")
    assert lookups.nearest(rows.where("id = 1"), mirrored, "x", "v", "k", digits=6).first().nearest.k == 1
