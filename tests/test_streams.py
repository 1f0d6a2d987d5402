"""State of streams over restarts, against one run and a loop."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.background import EmaConfig
from tidemark.streaming import pipeline

SCHEMA = "device long, id long, us long, source string, result string, gm long, reset boolean"


def rows(first, n):
    return [(k % 3, k, 1000 * k, ("rtc", "pir", None)[k % 3 if k % 5 else 0], ("clouds", None)[k % 2], (k * 37) % 256, k % 17 == 16) for k in range(first, first + n)]


def loop(events, z, c=EmaConfig()):
    states, out = {}, {}
    for device, i, _, source, result, gm, reset in events:
        mean, variance, count = states.get(device, (c.start_mean, c.start_variance, 0))
        if reset:
            states.pop(device, None)
            continue
        far = abs(gm - mean) / variance**0.5
        odd = far > z and count > 0
        out[i] = (round(far, 9), odd)
        if (source == "rtc" or result == "clouds") and not odd:
            mean = (1 - c.alpha) * mean + c.alpha * gm
            variance = max((1 - c.alpha) * variance + c.alpha * (gm - mean) ** 2, c.floor)
            count += 1
        states[device] = (mean, variance, count)
    return out


def test_state_lives_through_a_restart(spark, tmp_path):
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    events = rows(0, 200)
    for part in (events[:90], events[90:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        got = pipeline.drain(pipeline.stateful_background(stream, 2.0), path=run)
        seen = events[: 90 if part[0][1] == 0 else 200]
        assert {r.id: (round(r.z, 9), r.anomalous) for r in got.collect()} == loop(seen, 2.0)


def test_history_warms_the_state(spark, tmp_path):
    source = str(tmp_path / "in")
    events = [r[:-1] + (False,) for r in rows(0, 150)]
    spark.createDataFrame(events[100:], SCHEMA).coalesce(1).write.parquet(source)
    states = pipeline.learned(spark.createDataFrame(events[:100], SCHEMA), 2.0)
    got = pipeline.drain(pipeline.stateful_background(spark.readStream.schema(SCHEMA).parquet(source), 2.0, initial=states))
    want = loop(events, 2.0)
    assert {r.id: (round(r.z, 9), r.anomalous) for r in got.collect()} == {k: v for k, v in want.items() if k >= 100}


@pytest.mark.parametrize("most", [1, 3, 100])
def test_spools_drop_the_oldest(spark, most):
    events = [(k % 2, k * 1_000_000, k) for k in range(11)]
    got = pipeline.bounded_spool(spark.createDataFrame(events, "device long, us long, id long"), "device", ["us", "id"], most).collect()
    for device in (0, 1):
        own = sorted(r.id for r in got if r.device == device)
        assert sorted(r.id for r in got if r.device == device and r.kept) == own[-most:]
        assert {r.dropped for r in got if r.device == device} == {max(0, len(own) - most)}


def test_deliveries_are_bounded_in_rows_and_time(spark):
    at = [0, 1, 2, 3, 19, 20, 21, 22, 23, 24, 55, 56]
    got = pipeline.flushes(spark.createDataFrame([(1, t * 1_000_000, k) for k, t in enumerate(at)], "device long, us long, id long"), "device", ["us", "id"], 4, 20.0).orderBy("id").collect()
    assert [r.flush for r in got] == [0, 0, 0, 0, 1, 2, 2, 2, 2, 3, 4, 4]
    assert pipeline.flushes(spark.createDataFrame([], "device long, us long, id long"), "device", ["us", "id"]).where(F.lit(True)).count() == 0


def test_states_are_kept_by_version(spark, tmp_path):
    from tidemark.streaming import snapshots

    source, run, at = str(tmp_path / "in"), str(tmp_path / "run"), str(tmp_path / "states")
    events = [r[:-1] + (False,) for r in rows(0, 200)]
    for k, part in enumerate((events[:80], events[80:140])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        pipeline.drain(pipeline.stateful_background(spark.readStream.schema(SCHEMA).parquet(source), 2.0), path=run)
        assert snapshots.keep(spark, run, "background", at) == k + 1
    assert snapshots.versions(spark, at) == [1, 2] and snapshots.batches(spark, run)[1] == 1
    own = {tuple(r) for r in snapshots.kept(spark, at).collect()}
    assert own == {tuple(r) for r in pipeline.learned(spark.createDataFrame(events[:140], SCHEMA), 2.0).collect()}
    assert {tuple(r) for r in snapshots.states(spark, run, "background", 0).collect()} == {tuple(r) for r in snapshots.kept(spark, at, 1).collect()} != own
    rest = str(tmp_path / "rest")
    spark.createDataFrame(events[140:], SCHEMA).coalesce(1).write.parquet(rest)
    got = pipeline.drain(pipeline.stateful_background(spark.readStream.schema(SCHEMA).parquet(rest), 2.0, initial=snapshots.kept(spark, at)))
    want = loop(events, 2.0)
    assert {r.id: (round(r.z, 9), r.anomalous) for r in got.collect()} == {k: v for k, v in want.items() if k >= 140}


def test_states_of_histories_are_folded_without_a_call_for_each_device(spark):
    """The states that histories leave, against a loop; devices with few rows cost no Python call."""
    rows = [(k % 40, 1000 - k, k, (k * 37) % 256, "rtc" if k % 3 else None) for k in range(400)]
    history = spark.createDataFrame([(d, us, i, gm, s, None) for d, us, i, gm, s in rows], "device long, us long, id long, gm long, source string, result string")
    states = pipeline.learned(history, 2.0)
    want = {}
    for d, _, _, gm, source in sorted(rows, key=lambda r: r[1]):
        mean, variance, count = want.get(d, (128.0, 256.0, 0))
        if source and not (abs(gm - mean) / variance**0.5 > 2.0 and count):
            mean = 0.85 * mean + 0.15 * gm
            want[d] = mean, max(0.85 * variance + 0.15 * (gm - mean) ** 2, 36.0), count + 1
    got = {r.device: (round(r["mean"], 9), round(r["variance"], 9), r["count"]) for r in states.collect()}
    assert got == {d: (round(m, 9), round(v, 9), n) for d, (m, v, n) in want.items()}
    assert "FlatMapGroupsInPandas" not in states._jdf.queryExecution().toString()
