"""The older cascade against a loop over cells, and edges of pipelines, schedules and files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import solar
from tidemark.operators import legacy
from tidemark.operators import pipelines as P
from tidemark.plans import pipelines as plans
from tidemark.sources import files

C = legacy.LegacyConfig(need=2, drift_tiles=2, indirect=95.0, spot_tiles=2, spot_dark=12.0, spot_noise=30.0, z=1.5, dark=15.0, fresh_dark=8.0, quiet=0.3)


def by_cells(frames, without):
    """Cell by cell with plain lists."""
    state, out = {}, []
    for i, hour, tile in frames:
        n = len(tile)
        mean, var, seen, prev = state.get(hour // 6, ([C.start_mean] * n, [C.start_variance] * n, 0, None))
        level = sum(tile) / n
        odd = [abs(x - m) / v**0.5 > C.z for x, m, v in zip(tile, mean, var)]
        dark = sum(o and x - m < -C.dark for o, x, m in zip(odd, tile, mean))
        fresh = dark if prev is None else sum(o and x - p < -C.fresh_dark for o, x, p in zip(odd, tile, prev))
        drops = noisy = 0
        still = False
        if prev is not None:
            drops, noisy = sum(x - p < -C.spot_dark for x, p in zip(tile, prev)), sum(abs(x - p) >= C.spot_noise for x, p in zip(tile, prev))
            still = abs(level - sum(prev) / n) < C.spot_still
        if level < C.night and without != "NIGHT":
            name = "NIGHT"
        elif seen < C.need and without != "WARMUP":
            name = "WARMUP"
        elif dark >= C.dark_tiles and fresh >= C.dark_tiles and without != "DARK_OBJ":
            name = "DARK_OBJ"
        elif level < C.indirect and without != "INDIRECT_LIGHT":
            name = "INDIRECT_LIGHT"
        elif still and 1 <= drops <= C.spot_tiles and noisy <= C.spot_noisy_tiles and without != "SPOT_CHANGE":
            name = "SPOT_CHANGE"
        elif sum(odd) / n <= C.quiet and without != "QUIET":
            name = "QUIET"
        elif prev is not None and dark >= C.drift_tiles and fresh < C.dark_tiles and without != "SCENE_DRIFT":
            name = "SCENE_DRIFT"
        else:
            name = "AMBIGUOUS"
        if seen < C.need or name in ("QUIET", "WARMUP", "SCENE_DRIFT", "NIGHT", "INDIRECT_LIGHT"):
            mean = [(1 - C.alpha) * m + C.alpha * x for m, x in zip(mean, tile)]
            var = [max((1 - C.alpha) * v + C.alpha * (x - m) ** 2, C.variance_floor) for v, x, m in zip(var, tile, mean)]
        state[hour // 6] = (mean, var, 0 if name == "SCENE_DRIFT" else seen + 1, tile)
        out.append((i, without, name))
    return out


def test_legacy_cascade_against_cells(spark):
    rng = random.Random(11)
    frames = []
    for i in range(240):
        base = 60 if i % 31 == 0 else 90 if i % 17 == 0 else 128
        tile = [base + rng.gauss(0, 4) for _ in range(12)]
        if i % 9 > 5:
            tile[:4] = [x - 45 for x in tile[:4]]
        if i % 7 == 3:
            tile[5] -= 20
        frames.append((i, (i // 40) * 5 % 24, tile))
    rows = spark.createDataFrame([("k", i, h, t) for i, h, t in frames] + [("k", 999, None, None)], "key string, id long, hour int, tile array<double>")
    sets = ("", *legacy.STAGES)
    got = sorted((r.id, r.without, r.trigger) for r in legacy.legacy_cascade(rows, "key", ["id"], C, sets).collect())
    want = sorted(x for s in sets for x in by_cells(frames, s))
    assert got == want
    assert {name for _, s, name in want if not s} >= {"NIGHT", "WARMUP", "DARK_OBJ", "INDIRECT_LIGHT", "QUIET", "SCENE_DRIFT"}
    assert legacy.legacy_cascade(rows.limit(0), "key", ["id"]).count() == 0


def test_blob_score_of_a_compact_spot(spark):
    field = [0.0] * 64
    for k in (9, 10, 17, 18):
        field[k] = 10.0
    field[63] = 50.0
    frame = spark.createDataFrame([(field,), ([0.0] * 64,)], "f array<double>")
    got = [r[0] for r in frame.select(P.blob_score(F.col("f"), P.Shape(8, 8), (90.0,), (2, 6))).collect()]
    assert got == [10.0, 0.0]


def test_first_frames_have_no_burst(spark):
    rows = spark.createDataFrame([("a", 1, [1.0] * 4), ("a", 2, [100.0, 1.0, 1.0, 1.0]), ("b", 1, [5.0] * 4)], "key string, id long, tile array<double>")
    rows = rows.withColumn("u", F.col("tile")).withColumn("v", F.col("tile"))
    got = P.burst_figures(P.with_previous(rows, "key", ["id"], ["tile", "u", "v"])).orderBy("key", "id").collect()
    assert [(r.frame, r.gm, r.prev_gm, r.n_changed, r.n_dark, r.n_chroma) for r in got] == [(1, 1, None, 0, 0, 0), (2, 25, 1, 1, 0, 1), (1, 5, None, 0, 0, 0)]


def test_schedule_is_the_chain_of_next_wakes(spark):
    days = spark.range(80, 90).select((F.lit(1704067200) + F.col("id") * 86400).alias("midnight"))
    wakes = sorted(r.wake for r in solar.schedule(days, "midnight", 120).collect())
    chain = spark.createDataFrame([(w,) for w in wakes], "w long").select("w", solar.next_wake(F.col("w"), 120).cast("long").alias("n")).orderBy("w").collect()
    assert [r.n for r in chain[:-1]] == wakes[1:]


def test_labels_and_stamps_of_files(spark, tmp_path):
    for name in ("bird/20240601_120000_a.jpg", "cloud cover/20240602_000001.jpg", "bird/x.jpg", "bird/20241301_120000.jpg", "bird/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = files.labelled_files(spark, str(tmp_path)).collect()
    assert sorted((r.label, str(r.taken_at), r.size) for r in got) == [("bird", "2024-06-01 12:00:00", 5), ("bird", "None", 5), ("bird", "None", 5), ("cloud cover", "2024-06-02 00:00:01", 5)]


@pytest.mark.parametrize("text, want", [('[{"name": "a"}, {"type": "int"}]', [("a", "exact", None)]), ("[]", []), ('{"name": "b", "type": "float", "tol": 0.25, "more": 1}', [("b", "float", 0.25)])])
def test_check_lists(spark, tmp_path, text, want):
    (tmp_path / "checks.json").write_text(text)
    assert [tuple(r) for r in files.check_list(spark, str(tmp_path / "checks.json")).collect()] == want


def test_swept_configurations_equal_runs_one_by_one(spark):
    """Every stage is reached, and a sample of each sweep's configurations equals the cascade's own runs."""
    sf, rng = "/root/testdata/sf0.001", random.Random(7)
    rows, reached = plans.swept_frames(spark, sf).cache(), set()
    sweeps = (("cascade_sweep", plans.SWEPT, 64), ("cascade_sweep", plans.SWEPT, 16), ("cascade_variants", plans.VARIANTS, 64))
    for name, grid, cells in sweeps:
        got = {(r.asDict().get("cells", 64), r.config): r for r in registry.queries()[name](spark, sf).collect()}
        configs = legacy.configurations(plans._SWEPT_FROM, grid)
        assert len(got) == len(configs) * (2 if name == "cascade_sweep" else 1)
        truth = {(r.sequence, r.id): r.process for r in rows.where(F.col("cells") == cells).collect()}
        for k in rng.sample(range(len(configs)), 5):
            own = legacy.legacy_cascade(rows.where(F.col("cells") == cells), "sequence", ["id"], configs[k]).collect()
            reached |= {r.trigger for r in own}
            count = lambda process, label: sum(truth[r.sequence, r.id] == process and r.label == label for r in own)  # noqa: B023, E731
            r = got[cells, k]
            assert (r.tp, r.fn, r.fp, r.tn) == (count(True, "process"), count(True, "clouds"), count(False, "process"), count(False, "clouds"))
            if name == "cascade_variants":
                assert [r[s.lower()] for s in legacy.STAGES] == [sum(o.trigger == s for o in own) for s in legacy.STAGES]
    assert reached >= {"NIGHT", "WARMUP", "DARK_OBJ", "QUIET", "INDIRECT_LIGHT"}


def test_quiet_over_dark_and_steady_cells():
    """The two variants, by hand: an odd bright cell, an odd dark one, and an unsteady one."""
    c = dict(start_mean=100.0, z=2.0, need=0, night=0.0, dark_tiles=9, quiet=0.3)
    tile, noise = np.array([200.0, 20.0, 100.0, 100.0]), np.array([100.0, 100.0, 10_000.0, 100.0])
    stages = {}
    for name, more in {"all": {}, "dark": {"dark_only": True}, "steady": {"steady": "abs", "steady_limit": 20.0}, "both": {"steady": "rel", "steady_limit": 0.2, "dark_only": True}}.items():
        for many in (False, True):
            config = legacy.LegacyConfig(**c, **more)
            own = legacy._Backgrounds(4, [config]) if many else legacy._Background(4, config)
            own.variance = noise[None].copy() if many else noise.copy()
            stages.setdefault(name, set()).add((*legacy.STAGES, "AMBIGUOUS")[own.step(tile)[0]] if many else own.stage(tile, ""))
    # 2 of 4 cells are odd, 1 of 4 dark and odd; 2 and 1 of the 3 steady ones
    assert stages == {"all": {"AMBIGUOUS"}, "dark": {"QUIET"}, "steady": {"AMBIGUOUS"}, "both": {"AMBIGUOUS"}}


def test_distortion_is_counted_with_the_whole_scale(spark):
    """A cell is judged by the scale as it is, not by the rounded one that is shown; some of these rows tell them apart."""
    import duckdb

    from tidemark import registry

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = dict(con.execute(f"SELECT id, distorted FROM ({registry.oracles()['brightness_distortion']})").fetchall())
    assert {r.id: r.distorted for r in registry.queries()["brightness_distortion"](spark, sf).collect()} == want
