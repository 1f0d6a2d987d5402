"""The acknowledged spool against a loop and over restarts with failures; the document store's files and versions."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.plans.streams import spool_rows
from tidemark.sources.docstore import Conflict, DocumentStore
from tidemark.sources.frames import frames
from tidemark.streaming import pipeline, spool

SF = "/root/testdata/sf0.001"
ROWS = "device long, us long, id long, bytes long, kind string, captured_at timestamp"


def loop(rows, config):
    """What becomes of one device's rows, told by another account: a queue of pending ids, a set on its way."""
    pending, sizes, away, number, until, out = [], {}, [], 0, None, []
    for us, i, size, kind in sorted(rows):
        if until is not None and us > until:
            out.append((until, away[0], number, "expired"))
            away, until = [], None
        if kind == "record":
            while sum(sizes[p] for p in pending) + size > config.bytes and any(p not in away for p in pending):
                gone = next(p for p in pending if p not in away)
                pending.remove(gone)
                out.append((us, gone, number, "dropped"))
            pending.append(i)
            sizes[i] = size
        elif kind == "wake" and until is None and pending:
            number, away, until = number + 1, pending[: config.records], us + int(config.seconds * 1e6)
            out += [(us, p, number, "sent") for p in away]
        elif kind == "accepted" and away:
            out.append((us, away[0], number, "accepted"))
            pending.remove(away[0])
            away = away[1:]
            until = until if away else None
        elif kind == "failed" and away:
            out.append((us, away[0], number, "failed"))
            away, until = [], None
    return out, pending, until


def random_rows(seed, n=400):
    rng = random.Random(seed)
    us, rows = 0, []
    for i in range(n):
        us += rng.choice((0, 1, 3, 9, 30)) * 1_000_000
        rows.append((us, i, rng.randint(0, 900), rng.choices(("record", "wake", "accepted", "failed"), (5, 2, 5, 1))[0]))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_a_spool_follows_its_rules(seed):
    config = spool.SpoolConfig(bytes=3000, records=3, seconds=20.0)
    rows, own, out = random_rows(seed), spool.Spool(config), []
    for us, i, size, kind in rows:
        out += own.step(kind, us, i, size)
    want, pending, until = loop(rows, config)
    assert out == want and [r[1] for r in own.records] == pending and own.until == until
    ends = [(o[1], o[3]) for o in out if o[3] in ("accepted", "dropped")]
    records = {i for _, i, _, kind in rows if kind == "record"}
    assert len({i for i, _ in ends}) == len(ends) and {i for i, _ in ends} | set(pending) == records  # nothing is lost or taken twice
    for i in records:  # a frame is sent again only after a delivery that ended without its answer
        sent = [o[2] for o in out if o[1] == i and o[3] == "sent"]
        broken = {o[2] for o in out if o[3] in ("failed", "expired")}
        assert len(sent) == len(set(sent)) and set(sent[:-1]) <= broken


def test_deliveries_go_on_after_restarts(spark, tmp_path):
    """Batches, restarts and timers leave the outcomes as they are."""
    config, devices = spool.SpoolConfig(bytes=3000, records=3, seconds=20.0), {d: random_rows(10 + d, 150) for d in (1, 2)}
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    last = max(r[0] for rows in devices.values() for r in rows)
    devices[1] += [(last + 60_000_000, 900, 5, "record"), (last + 60_000_000, 901, 0, "wake")]  # left for a timer to end
    last += 60_000_000
    for part in range(3):
        some = [(d, us, i, size, kind) for d, rows in devices.items() for us, i, size, kind in rows if us * 3 // (last + 1) == part]
        some += [(3, last + 100_000_000, 0, 1, "wake")] if part == 2 else []  # moves the watermark beyond all deliveries
        spark.createDataFrame(some, "device long, us long, id long, bytes long, kind string").withColumn("captured_at", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(source)
        got = pipeline.drain(spool.acknowledged(spark.readStream.schema(ROWS).parquet(source), config=config), path=run)
    rows = [(r.device, r.us, r.id, r.delivery, r.outcome) for r in got.collect()]
    for d, own in devices.items():
        want, pending, until = loop(own, config)
        assert (until is not None) or d != 1
        want += [(until, pending[0], max(o[2] for o in want), "expired")] if until is not None else []
        assert sorted(r[1:] for r in rows if r[0] == d) == sorted(want)


def test_the_spool_query_over_a_whole_table(spark):
    got = sorted(tuple(r) for r in registry.queries()["spool_acknowledged"](spark, SF).collect() if r.outcome != "expired")
    config = spool.SpoolConfig(bytes=60_000, records=8, seconds=86_400.0)
    by = {}
    for r in spool_rows(frames(spark, SF)).collect():
        by.setdefault(r.device, []).append((r.us, r.id, r["bytes"], r.kind))
    want = sorted((d, *o) for d, rows in by.items() for o in loop(rows, config)[0] if o[3] != "expired")
    assert got == want and {o[4] for o in want} >= {"sent", "accepted"}


@pytest.fixture
def store(spark, tmp_path):
    made = DocumentStore(spark, str(tmp_path / "table"), "id")
    made.append(spark.range(1000).select("id", (F.col("id") % 7).alias("x"), F.lit(None).cast("string").alias("label")), 8)
    return made


def contents(store, version=None):
    return {Path(f["path"].removeprefix("file:")): Path(f["path"].removeprefix("file:")).read_bytes() for f in store.manifest(version)[1]}


def labels(spark, *ids):
    return spark.createDataFrame([(i, "bird") for i in ids], "id long, label string")


def test_unaffected_files_keep_their_bytes(spark, store):
    before = contents(store)
    version, rewritten = store.update(labels(spark, 3, 5, 700, 5_000_000), {"label": F.col("change.label")})
    after = contents(store)
    assert (version, rewritten) == (2, 2) and len(before) == 8 and len(before.keys() & after.keys()) == 6
    assert all(after[p] == before[p] for p in before.keys() & after.keys())
    assert {(r.id, r.x) for r in store.read().where("label = 'bird'").collect()} == {(3, 3), (5, 5), (700, 0)}
    assert store.read().count() == 1000 and store.read(1).where("label IS NOT NULL").count() == 0
    assert store.update(labels(spark, 5_000_000), {"label": F.col("change.label")}) == (2, 0) and store.update(labels(spark), {}) == (2, 0)


def test_a_crash_leaves_the_old_table(spark, store, monkeypatch):
    before = contents(store)

    def fails(version, files):
        raise OSError("the link is down")

    monkeypatch.setattr(store, "_publish", fails)
    with pytest.raises(OSError):
        store.update(labels(spark, 3), {"label": F.col("change.label")})
    monkeypatch.undo()
    assert store.manifest()[0] == 1 and contents(store) == before and store.read().where("label IS NOT NULL").count() == 0
    assert store.vacuum() == 1 and store.vacuum() == 0 and contents(store) == before


def test_of_two_writers_one_is_first(spark, store):
    version, files = store.manifest()
    store.update(labels(spark, 3), {"label": F.col("change.label")})
    with pytest.raises(Conflict):
        store._publish(version + 1, files)
    assert store.versions() == [1, 2] and store.read().where("label = 'bird'").count() == 1
    with pytest.raises(ValueError, match="no table"):
        DocumentStore(spark, store.path + "-none", "id").read()
