"""Parallel recurrences against loops, exact selection against Spark's own percentile, JSON with repeated keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import recurrence, selection
from tidemark.operators.background import EmaConfig
from tidemark.sources.frames import document


def looped(rows, west, c=EmaConfig()):
    states, out = {}, {}
    for key, at, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        mean, variance = states.get(key, (c.start_mean, c.start_variance))
        before = (mean, variance)
        if west:
            d = x - mean
            mean, variance = mean + c.alpha * d, (1 - c.alpha) * (variance + c.alpha * d * d)
        else:
            mean = (1 - c.alpha) * mean + c.alpha * x
            variance = max((1 - c.alpha) * variance + c.alpha * (x - mean) ** 2, c.floor)
        states[key] = (mean, variance)
        out[key, at] = (*before, mean, variance)
    return out


@pytest.mark.parametrize("west", [False, True])
@pytest.mark.parametrize("parts", [1, 7])
def test_means_and_variances_of_each_row(spark, west, parts):
    rng = np.random.default_rng(parts)
    rows = [(None if k % 7 == 0 else k % 4, k, float(x)) for k, x in enumerate(rng.integers(0, 256, 900))] + [(9, k, 100.0 + k % 3) for k in range(4000)] + [(8, 1, 3.0)]
    frame = spark.createDataFrame(rows, "device int, us long, x double").repartition(5)
    got = {(r.device, r.us): (r.before_mean, r.before_variance, r.mean, r.variance) for r in recurrence.ema(frame, "device", ["us"], "x", west, parts=parts).collect()}
    want = looped(rows, west)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-9) for k in want)
    assert recurrence.ema(frame.limit(0), "device", ["us"], "x", west).count() == 0


def test_one_device_of_a_million_events(spark):
    """The history lies in several parts, and its last state is the loop's."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("device"), F.col("id").alias("us"), (F.pmod(F.xxhash64("id"), F.lit(256))).cast("double").alias("x"))
    got = recurrence.ema(rows, "device", ["us"], "x", parts=8)
    last = got.where("us IN (0, 499999, 999999)").select("us", "mean", "variance").collect()
    xs = [r.x for r in rows.orderBy("us").select("x").collect()]
    want = looped([(1, k, x) for k, x in enumerate(xs)], False)
    assert {r.us for r in last} == {0, 499999, 999999} and all(np.allclose((r.mean, r.variance), want[1, r.us][2:], rtol=1e-12) for r in last)


def test_maps_compose_like_one_after_the_other():
    rng = np.random.default_rng(0)
    p, q, c = rng.random(200), rng.standard_normal(200), np.where(rng.random(200) < 0.3, recurrence.NO_FLOOR, rng.standard_normal(200))
    p[::17] = 0
    new = rng.random(200) < 0.1
    new[0] = True
    y, want = 0.0, []
    for k in range(200):
        y = max(p[k] * (5.0 if new[k] else y) + q[k], c[k])
        want.append(y)
    P, Q, C = recurrence.prefixes((p, q, c), new)
    assert np.allclose(np.maximum(P * 5.0 + Q, C), want)


FRACTIONS = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("most, accuracy", [(50_000, 1000), (40, 20), (1, 100)])
def test_quantiles_equal_spark_s(spark, most, accuracy):
    rng = np.random.default_rng(most)
    values = np.concatenate([rng.standard_normal(3000), np.full(2000, 2.5), np.full(2000, 2.75), rng.standard_cauchy(2000) * 1e6, [1e300, -1e300, 1e-300]])
    rows = [(None if i % 5 == 0 else i % 5, float(x)) for i, x in enumerate(values)] + [(77, 1.0), (78, None), (79, 3.0), (79, 4.0), (80, 7.0)] + [(80, 7.0)] * 100
    frame = spark.createDataFrame(rows, "g int, v double").repartition(6)
    got = {r.g: (r.n, r.quantiles) for r in selection.quantiles(frame, ["g"], "v", FRACTIONS, most, accuracy).collect()}
    want = {r.g: (r.n, r.q) for r in frame.where("v IS NOT NULL").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, FRACTIONS))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and np.allclose(got[g][1], want[g][1], rtol=1e-12, atol=0) for g in want)
    assert selection.quantiles(frame, [], "v", [0.5], most, accuracy).first().quantiles == [frame.agg(F.percentile("v", F.lit(0.5))).first()[0]]
    assert selection.quantiles(frame.limit(0), ["g"], "v", [0.5]).count() == 0


def test_medians_and_deviations(spark):
    rows = [(k % 3, float((k * 37) % 101) / 7) for k in range(999)] + [(None, 5.0)]
    got = {r.g: (r.median, r.mad) for r in selection.median_and_deviation(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", most=20).collect()}
    for g in (0, 1, 2, None):
        own = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx((np.median(own), 1.4826 * np.median(np.abs(own - np.median(own)))))


def test_the_last_of_repeated_keys_counts(spark):
    texts = ['{"r":"early","gm":3,"r":"late"}', '{"r":1,"r":null}', '{"r":"a","r":{"x":[1,"q"]},"s":"1"}', "junk", "[1]", "", None, '{"r":{"x":1,"x":2}}', '{"r":1,"r":2', "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", document(F.col("t")).cast("string").alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == ['{"gm":3,"r":"late"}', '{"r":null}', '{"r":{"x":[1,"q"]},"s":"1"}', "{}", "[1]", "{}", "{}", "{}", "{}", "{}"]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_long_lists_of_checks_are_joined(spark, monkeypatch):
    from tidemark.operators import documents

    frame = spark.createDataFrame([(1, {"a": "1", "b": "x", "c": "3"}, {"a": "2", "b": "x"}), (2, {"a": "1"}, None), (3, None, {"a": "1"})], "id int, e map<string,string>, a map<string,string>")
    checks = spark.createDataFrame([("a", "int", None), ("b", "exact", None), ("c", "exact", None), ("d", "int", 2.0), ("a", "float", 1.5)], "name string, kind string, tolerance double")
    found = lambda: sorted((r.id, r.check.name, r.check.kind, r.mismatch) for r in documents.parity(frame, checks, "e", "a").collect())
    want = found()
    assert want == [(1, "a", "float", False), (1, "a", "int", True), (1, "b", "exact", False)]
    monkeypatch.setattr(documents, "MOST_CHECKS", 2)
    assert found() == want
