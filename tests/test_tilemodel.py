"""The background that learns in the stream's state, against loops over tiles."""

import random
import statistics

from pyspark.sql import functions as F

from tidemark import registry
from tidemark.plans import streams
from tidemark.streaming import pipeline as P
from tidemark.streaming import tilemodel

SF = "/root/testdata/sf0.001"
SIDE = 8


def line(xs, ys):
    mx, my = statistics.fmean(xs), statistics.fmean(ys)
    a = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    return a, my - a * mx


def largest(cells):
    left, top = set(cells), 0
    while left:
        todo, n = [left.pop()], 0
        while todo:
            k = todo.pop()
            n += 1
            near = {(k // SIDE + dy) * SIDE + k % SIDE + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= k % SIDE + dx < SIDE} & left
            left -= near
            todo += near
        top = max(top, n)
    return top


def loop(frames, c):
    """id -> (bucket, warmup, ratio, dark tiles, dark blob, texture blob, trigger, taught), tile by tile."""
    models, out = {}, {}
    for device, _, event, timer, y, u, v, rough in sorted(frames, key=lambda f: (f[0], f[1], f[2])):
        n = len(y)
        bucket = sum(int(sum(y) / n) >= e for e in c.edges)
        m = models.setdefault((device, bucket), [[c.start_mean] * n, [c.start_mean] * n, [c.start_mean] * n, [c.start_variance] * n, 0])
        lit = [k for k in range(n) if m[0][k] > c.floor]
        a, b = 1.0, 0.0
        if len(lit) >= c.least and statistics.pstdev([m[0][k] for k in lit]) > 1.0:
            a, b = line([m[0][k] for k in lit], [y[k] for k in lit])
            kept = sorted(lit, key=lambda k: abs(a * m[0][k] + b - y[k]))[: max(c.least, int(len(lit) * (1 - c.trim)))]
            a, b = line([m[0][k] for k in kept], [y[k] for k in kept])
        gap = [y[k] - (a * m[0][k] + b) for k in range(n)]
        ratio = sum(g < 0 and -g / m[3][k] ** 0.5 > c.z for k, g in enumerate(gap)) / n
        du, dv = ([p[k] - q[k] for k in range(n)] for p, q in ((u, m[1]), (v, m[2])))
        mu, mv = statistics.median(du), statistics.median(dv)
        dark = [k for k, g in enumerate(gap) if g < -c.dark or g < 0 and (du[k] - mu) ** 2 + (dv[k] - mv) ** 2 > c.chroma_sq]
        woven = [k for k, g in enumerate(gap) if rough[k] > c.rough and g < -c.loose]
        blobs = largest(dark), largest(woven)
        warmup = max(0, c.need - m[4])
        trigger = "WARMUP" if warmup else "DARK_BLOB" if any(1 <= s <= c.blob for s in blobs) else "QUIET" if ratio <= c.quiet else "AMBIGUOUS"
        taught = timer and trigger in ("WARMUP", "QUIET")
        if taught:
            for plane, x in enumerate((y, u, v)):
                m[plane] = [(1 - c.alpha) * p + c.alpha * q for p, q in zip(m[plane], x, strict=True)]
            m[3] = [max((1 - c.alpha) * s + c.alpha * (q - p) ** 2, c.variance_floor) for s, p, q in zip(m[3], m[0], y, strict=True)]
            m[4] += 1
        out[event] = (bucket, warmup, round(ratio, 9), len(dark), *blobs, trigger, taught)
    return out


def result(rows):
    return {r.id: (r.bucket, r.warmup, round(r.ratio, 9), r.dark_tiles, r.dark_blob, r.texture_blob, r.trigger, r.taught) for r in rows}


def scenes(seed, n):
    """Frames of three devices over a scene in changing light, with birds, clouds and noise."""
    rng = random.Random(seed)
    scene = [rng.uniform(30, 200) for _ in range(SIDE * SIDE)]
    out = []
    for k in range(n):
        gain, tint = rng.choice((0.8, 1.2)) + rng.uniform(-0.04, 0.04), rng.uniform(-10, 10)
        y = [gain * s + rng.gauss(0, 3) for s in scene]
        u, v = ([100 + tint + 0.1 * s + rng.gauss(0, 1) for s in scene] for _ in range(2))
        rough = [abs(rng.gauss(0, 4)) for _ in scene]
        kind = rng.randrange(5)
        for j in rng.sample(range(SIDE * SIDE), 24) if kind == 0 else [27, 28] if kind == 1 else [10] if kind == 2 else []:
            y[j] -= (110, 60, 15)[kind]
            rough[j] += 20
            u[j] += 30 if kind == 1 else 0
        out.append((k % 3, k, k, rng.random() < 0.7, y, u, v, rough))
    return out


def test_frames_are_judged_as_by_loops_and_state_outlives_a_batch(spark, tmp_path):
    frames = scenes(0, 240)
    kind = "device long, us long, id long, timer boolean, y array<double>, u array<double>, v array<double>, rough array<double>"
    for part in (frames[:100], [*frames[100:], (0, 999, 999, True, None, None, None, None)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    config = tilemodel.TileConfig(edges=(110.0,), need=5, quiet=0.15)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = result(P.drain(tilemodel.judged(stream, SIDE, SIDE, config)).collect())
    want = loop(frames, config)
    assert got == want
    assert {r[6] for r in want.values()} == {"WARMUP", "DARK_BLOB", "QUIET", "AMBIGUOUS"} and {r[0] for r in want.values()} == {0, 1}


def test_the_query_equals_the_loops(spark):
    grids = spark.read.parquet(f"{SF}/embeddings.parquet")
    frames = []
    for r in streams.camera_frames(grids).withColumn("y", F.col("r")).collect():
        mirrored = lambda j: -1 - j if j < 0 else 2 * SIDE - 1 - j if j >= SIDE else j
        blur = [statistics.fmean(r.y[mirrored(k // SIDE + dy) * SIDE + mirrored(k % SIDE + dx)] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) for k in range(SIDE * SIDE)]
        frames.append((r.device, r.us, r.id, r.teaches, r.y, r.g, r.b, [abs(x - b) for x, b in zip(r.y, blur, strict=True)]))
    want = loop(frames, streams.TILES)
    assert result(registry.queries()["stream_learned_background"](spark, SF).collect()) == want
    assert {r[6] for r in want.values()} == {"WARMUP", "DARK_BLOB", "QUIET", "AMBIGUOUS"}
