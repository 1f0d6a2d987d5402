"""Components of masks by flood fill; learned regimes against a camera told cell by cell, over restarts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import blobs, regimes
from tidemark.operators.fitting import phase_shift
from tidemark.plans import streams
from tidemark.streaming import pipeline
from tidemark.streaming import regimes as streamed

SF = "/root/testdata/sf0.001"


def flooded(mask, diagonal):
    h, w = len(mask), len(mask[0]) if len(mask) else 0
    seen, sizes = set(), []
    for y in range(h):
        for x in range(w):
            if mask[y][x] and (y, x) not in seen:
                stack, n = [(y, x)], 0
                seen.add((y, x))
                while stack:
                    a, b = stack.pop()
                    n += 1
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            p = (a + dy, b + dx)
                            if (diagonal or not (dy and dx)) and 0 <= p[0] < h and 0 <= p[1] < w and mask[p[0]][p[1]] and p not in seen:
                                seen.add(p)
                                stack.append(p)
                sizes.append(n)
    return sizes


def spiral(n):
    mask, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    free = lambda a, b: 0 <= a < n and 0 <= b < n and not mask[a, b]
    mask[0, 0] = True
    while True:
        for _ in range(2):
            if free(y + dy, x + dx) and (not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n) or not mask[y + 2 * dy, x + 2 * dx]):
                break
            dy, dx = dx, -dy
        else:
            return mask
        y, x = y + dy, x + dx
        mask[y, x] = True


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_of_masks(diagonal):
    rng = np.random.default_rng(3)
    masks = [rng.random((h, w)) < p for h, w in ((1, 1), (7, 9), (30, 41), (1, 20), (20, 1)) for p in (0.0, 0.2, 0.5, 0.7, 1.0)] + [spiral(41), ~spiral(41), np.ones((50, 50), bool), np.zeros((0, 3), bool)]
    for mask in masks:
        assert blobs.sizes(mask, diagonal).tolist() == flooded(mask.tolist(), diagonal)
    large = spiral(401)
    assert blobs.sizes(large, diagonal).tolist() == [int(large.sum())] and large.size > 100_000


def test_blobs_of_rows(spark):
    rows = [(1, [True, True, None, False, True], 2), (2, None, 3), (3, [], 3), (4, [True] * 7, 3)]
    got = {r.k: (r.cells, r.sizes) for r in blobs.blob_sizes(spark.createDataFrame(rows, "k int, m array<boolean>, w int"), "k", "m", "w", False).collect()}
    assert got == {1: (3, [2, 1]), 2: (0, []), 3: (0, []), 4: (7, [7])}


def test_image_blobs_of_whole_texts(spark):
    got = {r.doc_id: (r.cells, r.blobs, r.largest) for r in registry.queries()["image_blobs"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        flat = [c in "aeiou" for c in r.text.lower()]
        flat += [False] * (-len(flat) % 120)
        sizes = flooded([flat[k : k + 120] for k in range(0, len(flat), 120)], True)
        assert got[r.doc_id] == (sum(flat), len(sizes), max(sizes, default=0))


class SlowCamera:
    """The camera again, cell by cell and without arrays of layers."""

    def __init__(self, h, w, c):
        self.h, self.w, self.c, self.bank, self.next, self.ref, self.off = h, w, c, [], 0, None, 0
        self.cells = [(y, x) for y in range(h) for x in range(w)]

    def box(self, a, r):
        mirror = lambda k, n: -1 - k if k < 0 else 2 * n - 1 - k if k >= n else k
        near = range(-r, r + 1)
        return {(y, x): sum(a[mirror(y + dy, self.h), mirror(x + dx, self.w)] for dy in near for dx in near) / (2 * r + 1) ** 2 for y, x in self.cells}

    def texture(self, y):
        soft = self.box(y, self.c.texture_radius)
        return self.box({k: abs(y[k] - soft[k]) for k in self.cells}, self.c.texture_radius)

    def see(self, planes, teaches):
        c, cells = self.c, self.cells
        rgb = {(y, x): [float(p[y][x]) for p in planes] for y, x in cells}
        gray = {k: 0.299 * v[0] + 0.587 * v[1] + 0.114 * v[2] for k, v in rgb.items()}
        flat = sorted(gray.values())
        mean = sum(flat) / len(flat)
        if mean < c.night:
            return -1, 0.0, 0.0, 0, 0, "-", "NIGHT"
        at = lambda p: (lambda q: flat[int(q)] + (flat[min(int(q) + 1, len(flat) - 1)] - flat[int(q)]) * (q - int(q)))((len(flat) - 1) * p)
        average = lambda v: sum(v) / len(v)
        d = [mean / 255, math.sqrt(average([(v - mean) ** 2 for v in flat])) / 64, average([v for v in flat if v >= at(0.75)]) / max(average([v for v in flat if v <= at(0.25)]), 1.0) / 8]
        near = min(self.bank, key=lambda m: (math.dist(d, m["d"]), m["name"]), default=None)
        distance = math.dist(d, near["d"]) if near else math.inf
        ready = near is not None and near["n"] >= c.warmup
        out, shift, sure, seen = (0, 0, "-", "WARMUP"), 0.0, 0.0, {k: (0.0, 0.0) for k in cells}
        if ready:
            if self.ref is not None:
                grid = lambda a: np.array([[a[y, x] for x in range(self.w)] for y in range(self.h)])
                dy, dx, sure = phase_shift(grid(self.ref), grid(gray))
                shift = math.hypot(dy, dx)
            alpha, cd = {}, {}
            for k in cells:
                sd = [max(math.sqrt(v), c.noise) for v in near["var"][k]]
                top = sum(a * m / s**2 for a, m, s in zip(rgb[k], near["mean"][k], sd, strict=True))
                alpha[k] = top / max(sum(m * m / s**2 for m, s in zip(near["mean"][k], sd, strict=True)), 1e-6)
                cd[k] = math.sqrt(sum(((a - alpha[k] * m) / s) ** 2 for a, m, s in zip(rgb[k], near["mean"][k], sd, strict=True)))
            around, rough = self.box(alpha, c.around_radius), self.texture(gray)
            seen = {k: (cd[k], max(0.0, around[k] - alpha[k])) for k in cells}
            colour, top = {}, {}
            for k in cells:
                (cm, am), (cv, av) = near["res"][k], near["resvar"][k]
                colour[k] = (seen[k][0] - cm) / max(math.sqrt(cv), c.colour_floor) / c.colour_z
                hides = min(1.0, max(0.0, 1 - rough[k] / (max(around[k], 0.05) * near["hf"][k] + 1e-3)))
                dark = (seen[k][1] - am) / max(math.sqrt(av), c.dark_floor) if near["hf"][k] <= c.texture or hides > c.hidden else 0.0
                top[k] = max(colour[k], dark / c.dark_z)
            score = self.box(top, c.smooth_radius)
            fired = [[score[y, x] > 1.0 for x in range(self.w)] for y in range(self.h)]
            clear = [n for n in flooded(fired, True) if n >= c.least_area]
            hot = [k for k in cells if score[k] > 1.0]
            channel = "-" if not hot else "colour" if sum(colour[k] > 1.0 for k in hot) / len(hot) > 0.5 else "dark"
            largest = max(clear, default=0)
            decision = "BUMP" if teaches and self.off >= 1 and shift > c.bump else "SCENE_EVENT" if distance > c.novelty or largest > c.big * len(cells) else "BIRD_CANDIDATE" if clear else "BACKGROUND"
            out = (len(clear), largest, channel, decision)
        if teaches:
            if shift > c.bump and sure > c.confidence and self.ref is not None:
                self.off += 1
            else:
                self.off, self.ref = 0, gray
            if out[3] == "BUMP" and self.off >= 2:
                self.bank, self.off, self.ref = [], 0, gray
                self.spawn(rgb, gray, d)
            elif near is None or distance > c.near:
                self.spawn(rgb, gray, d)
            else:
                self.teach(near, rgb, gray, d, seen)
        return (near["name"] if near else -1), distance, shift, *out

    def spawn(self, rgb, gray, d):
        c = self.c
        self.bank.append({"name": self.next, "mean": rgb, "var": {k: [c.noise**2] * 3 for k in rgb}, "res": {k: [0.0, 0.0] for k in rgb}, "resvar": {k: [1.0, c.dark_variance] for k in rgb}, "hf": self.texture(gray), "d": d, "n": 1})
        self.next += 1
        if len(self.bank) > c.most:
            pairs = [(math.dist(a["d"], b["d"]), i, j) for i, a in enumerate(self.bank) for j, b in enumerate(self.bank) if i < j]
            _, i, j = min(pairs)
            a, b = self.bank[i], self.bank.pop(j)
            mix = lambda x, y: (x * a["n"] + y * b["n"]) / (a["n"] + b["n"])
            for f in ("mean", "var", "res", "resvar"):
                a[f] = {k: [mix(x, y) for x, y in zip(a[f][k], b[f][k], strict=True)] for k in a[f]}
            a["hf"], a["d"] = {k: mix(a["hf"][k], b["hf"][k]) for k in a["hf"]}, [mix(x, y) for x, y in zip(a["d"], b["d"], strict=True)]
            a["n"] += b["n"]

    def teach(self, m, rgb, gray, d, seen):
        def follow(level, var, x, rate):
            gap = x - level
            return level + rate * gap, (1 - rate) * (var + rate * gap * gap)

        for level, var, new, rate in (("mean", "var", rgb, self.c.rate), ("res", "resvar", seen, self.c.slow)):
            both = {k: [follow(a, b, x, rate) for a, b, x in zip(m[level][k], m[var][k], new[k], strict=True)] for k in rgb}
            m[level], m[var] = {k: [p[0] for p in v] for k, v in both.items()}, {k: [p[1] for p in v] for k, v in both.items()}
        rough = self.texture(gray)
        m["hf"] = {k: v + self.c.rate * (rough[k] - v) for k, v in m["hf"].items()}
        m["d"] = [a + self.c.rate * (b - a) for a, b in zip(m["d"], d, strict=True)]
        m["n"] += 1


def scene(seed, n, h, w):
    """Frames of a textured scene under changing light, with dark things in it, nights, and a camera that is moved once."""
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    base, out = rng.uniform(60, 200, (3, h + 6, w + 6)), []
    for k in range(n):
        off = 3 if k > 2 * n // 3 else 0
        frame = base[:, off : off + h, off : off + w] * (pick.choice((0.6, 1.0, 1.2)) if k % 12 == 0 else 1.0) + rng.normal(0, 2, (3, h, w))
        if pick.random() < 0.2:
            y, x = pick.randrange(h - 3), pick.randrange(w - 3)
            frame[:, y : y + 3, x : x + 3] *= pick.choice((0.2, 0.5))
            frame[pick.randrange(3), y : y + 3, x : x + 3] += pick.choice((0, 120))
        out.append((frame * 0.1 if pick.random() < 0.04 else frame, pick.random() < 0.7))
    return out


TEST = regimes.RegimeConfig(warmup=4, near=0.05, most=3, colour_z=3.0, dark_z=3.0, texture_radius=1, around_radius=2, least_area=2, novelty=0.6, big=0.25, bump=1.5, confidence=3.0)


def same(got, want):
    return got[0] == want[0] and got[3:] == want[3:] and (got[1] == want[1] or math.isclose(got[1], want[1], rel_tol=1e-6, abs_tol=1e-9)) and math.isclose(got[2], want[2], rel_tol=1e-6, abs_tol=1e-6)


def test_a_camera_cell_by_cell():
    fast, slow, decisions = regimes.Camera(TEST), SlowCamera(15, 16, TEST), set()
    for frame, teaches in scene(1, 120, 15, 16):
        got, want = fast.see(frame, teaches), slow.see(frame, teaches)
        assert same(got, want), (got, want)
        decisions.add(got[-1])
        assert {k: r.count for k, r in fast.regimes.items()} == {m["name"]: m["n"] for m in slow.bank}
    assert decisions >= {"NIGHT", "WARMUP", "BACKGROUND", "SCENE_EVENT", "BIRD_CANDIDATE", "BUMP"}


def test_regimes_live_through_restarts(spark, tmp_path):
    source, run, schema = str(tmp_path / "in"), str(tmp_path / "run"), "device long, us long, id long, teaches boolean, r array<double>, g array<double>, b array<double>"
    frames = {d: scene(5 + d, 40, 9, 10) for d in (1, 2)}
    for part in range(2):
        rows = [(d, k, k, t, *[p.ravel().tolist() for p in f]) for d, own in frames.items() for k, (f, t) in enumerate(own) if k // 20 == part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = pipeline.drain(streamed.regimes(spark.readStream.schema(schema).parquet(source), 9, 10, TEST), path=run)
    found = {(r.device, r.id): tuple(r)[2:] for r in got.collect()}
    for d, own in frames.items():
        camera = regimes.Camera(TEST)
        for k, (frame, teaches) in enumerate(own):
            assert same(found[d, k], camera.see(frame, teaches))


def test_the_regime_query_over_a_whole_table(spark):
    got = {r.id: tuple(r)[2:] for r in registry.queries()["stream_regimes"](spark, SF).collect()}
    rows = streams.camera_frames(spark.read.parquet(f"{SF}/embeddings.parquet")).orderBy("id").collect()
    cameras, decisions = {}, set()
    for r in rows:
        camera = cameras.setdefault(r.device, SlowCamera(8, 8, streams.REGIMES))
        want = camera.see([np.reshape(p, (8, 8)) for p in (r.r, r.g, r.b)], r.teaches)
        assert same(got[r.id], want), (r.id, got[r.id], want)
        decisions.add(want[-1])
    assert len(got) == len(rows) and len(decisions) > 3
    assert spark.range(1).where(F.lit(len(cameras) > 1)).count() == 1
