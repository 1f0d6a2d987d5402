"""Kernels over small grids stored as arrays, row by row, of a fixed height and width.

Sums over a grid's cells are folds of one row, so grids are never exploded or shuffled; a fold is interpreted, at some
tens of nanoseconds a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.binding import let


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a)))


def count_where(a: Column, test) -> Column:
    return F.size(F.filter(a, test))


def median(a: Column) -> Column:
    """With the mean of the two middle ones."""
    return let(F.sort_array(a), lambda s: (F.element_at(s, F.expr("1").cast("int") * F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)) / 2)


def z_scores(tile: Column, model: Column, variance: Column) -> Column:
    gap = F.zip_with(tile, model, lambda x, m: F.abs(x - m))
    return F.zip_with(gap, variance, lambda d, v: d / F.sqrt(v))


def dark_anomalies(tile: Column, model: Column, variance: Column, z: float = 3.0) -> Column:
    """Cells that are darker than the model by more than z deviations."""
    darker = F.zip_with(tile, model, lambda x, m: x < m)
    return F.zip_with(z_scores(tile, model, variance), darker, lambda s, d: (s > z) & d)


def share(mask: Column) -> Column:
    return count_where(mask, lambda m: m) / F.size(mask)


def chroma_sq(u: Column, v: Column, mu: Column, mv: Column, centred: bool = True) -> Column:
    """Squared colour distance, after the frame's own median shift is taken off."""
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    shift = (lambda d: let(d, lambda e: let(median(e), lambda m: F.transform(e, lambda x: x - m)))) if centred else (lambda d: d)
    return F.zip_with(shift(gap(u, mu)), shift(gap(v, mv)), lambda x, y: x * x + y * y)


def line(pairs: Column) -> Column:
    """struct(a, b) of the least-squares line y = a x + b through an array of struct(x, y)."""
    sums = F.aggregate(
        pairs,
        F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "xy")]),
        lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["xy"] + p["x"] * p["y"]).alias("xy")),
    )

    def solve(s: Column) -> Column:
        return let((s["n"] * s["xy"] - s["x"] * s["y"]) / (s["n"] * s["xx"] - s["x"] * s["x"]), lambda a: F.struct(a.alias("a"), ((s["y"] - a * s["x"]) / s["n"]).alias("b")))

    return let(sums, solve)


def trimmed_line(model: Column, tile: Column, floor: float, least: int, deviation_over: float, keep: float = 0.9) -> Column:
    """The line of tile over model on cells with model > floor, fitted again without the worst tenth; (1, 0) if there are
    fewer than `least` such cells or they hardly differ."""
    pairs = F.filter(F.zip_with(model, tile, lambda m, t: F.struct(m.cast("double").alias("x"), t.cast("double").alias("y"))), lambda p: p["x"] > floor)

    def refit(p: Column) -> Column:
        def trim(l: Column) -> Column:
            ranked = F.array_sort(F.transform(p, lambda q: F.struct(F.abs(q["y"] - (l["a"] * q["x"] + l["b"])).alias("r"), q["x"].alias("x"), q["y"].alias("y"))))
            n = F.greatest(F.lit(least), F.floor(F.size(p) * keep).cast("int"))
            return line(F.slice(ranked, F.lit(1), n))

        good = (F.size(p) >= least) & (deviation(F.transform(p, lambda q: q["x"])) > deviation_over)
        return F.when(good, let(line(p), trim)).otherwise(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")))

    return let(pairs, refit)


def neighbours(h: int, w: int, diagonal: bool) -> list[list[int]]:
    """For each cell, the cells that touch it, from 0."""
    out = []
    for k in range(h * w):
        y, x = divmod(k, w)
        near = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
        out.append([p * w + q for p, q in near if 0 <= p < h and 0 <= q < w])
    return out


def components(mask: Column, h: int, w: int, diagonal: bool) -> Column:
    """The smallest cell number (from 1) of each cell's blob, 0 outside. Labels sink along neighbours in as many sweeps as
    there are cells, which reaches the end of any spiral; a sweep that changes nothing is left out."""
    near = F.array(*[F.array(*[F.lit(j + 1) for j in c]) for c in neighbours(h, w, diagonal)])
    cells = F.sequence(F.lit(1), F.lit(h * w))
    first = F.zip_with(cells, mask, lambda k, m: F.when(m, k).otherwise(0))

    def sweep(labels: Column) -> Column:
        sink = lambda k: F.aggregate(F.element_at(near, k), F.element_at(labels, k), lambda s, j: F.when(F.element_at(labels, j) > 0, F.least(s, F.element_at(labels, j))).otherwise(s))
        return F.transform(cells, lambda k: F.when(F.element_at(labels, k) > 0, sink(k)).otherwise(0))

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(let(sweep(state["labels"]), lambda new: F.struct(new.alias("labels"), (new == state["labels"]).alias("done"))))

    start = F.struct(first.alias("labels"), F.lit(False).alias("done"))
    return F.aggregate(cells, start, step, lambda s: s["labels"])


def blob_sizes(labels: Column) -> Column:
    """An array of the blobs' sizes."""
    known = F.filter(labels, lambda x: x > 0)
    return F.transform(F.array_distinct(known), lambda b: F.size(F.filter(known, lambda x: x == b)))


def largest_blob(labels: Column) -> Column:
    return F.coalesce(F.array_max(blob_sizes(labels)), F.lit(0))


def box_blur(a: Column, h: int, w: int, radius: int, padding: str) -> Column:
    """The mean of the (2 radius + 1)-square around each cell. padding `nearest` repeats the edge, `reflect` mirrors with
    the edge repeated."""

    def inside(i: int, n: int) -> int:
        if padding == "nearest":
            return min(max(i, 0), n - 1)
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    span = range(-radius, radius + 1)
    cells = [[inside(y + p, h) * w + inside(x + q, w) + 1 for p in span for q in span] for y in range(h) for x in range(w)]
    table = F.array(*[F.array(*map(F.lit, c)) for c in cells])
    return F.transform(table, lambda c: F.aggregate(c, F.lit(0.0), lambda s, k: s + F.element_at(a, k)) / F.size(c))


def high_pass(tile: Column, model: Column, h: int, w: int, radius: int, padding: str = "nearest") -> Column:
    """How much darker than the model each cell is beside its surroundings: (M - blur M) - (T - blur T)."""
    sharp = lambda a: F.zip_with(a, box_blur(a, h, w, radius, padding), lambda x, b: x - b)
    return F.zip_with(sharp(model), sharp(tile), lambda m, t: m - t)


def maximum_filter(a: Column, h: int, w: int) -> Column:
    near = F.array(*[F.array(*[F.lit(j + 1) for j in (k, *c)]) for k, c in enumerate(neighbours(h, w, True))])
    return F.transform(near, lambda c: F.array_max(F.transform(c, lambda k: F.element_at(a, k))))


def gradient(a: Column, h: int, w: int) -> Column:
    """Length of the central differences, one-sided at the edges."""
    spans = []
    for k in range(h * w):
        y, x = divmod(k, w)
        up, down, left, right = max(y - 1, 0), min(y + 1, h - 1), max(x - 1, 0), min(x + 1, w - 1)
        spans.append([up * w + x + 1, down * w + x + 1, max(down - up, 1), y * w + left + 1, y * w + right + 1, max(right - left, 1)])
    table = F.array(*[F.array(*map(F.lit, s)) for s in spans])
    at = lambda s, i: F.element_at(s, i)
    return F.transform(table, lambda s: F.hypot((F.element_at(a, at(s, 2)) - F.element_at(a, at(s, 1))) / at(s, 3), (F.element_at(a, at(s, 5)) - F.element_at(a, at(s, 4))) / at(s, 6)))


def descriptor(a: Column) -> Column:
    """[mean / 255, deviation / 64, mean of the upper quarter / that of the lower one / 8], quarters by interpolated
    quartiles, their edges inside on both sides."""

    def at(s: Column, p: float) -> Column:
        place = (F.size(s) - 1) * p
        low = F.floor(place).cast("int")
        x, y = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, F.size(s)))
        return x + (y - x) * (place - low)

    def of(s: Column) -> Column:
        high = mean(F.filter(s, lambda x: x >= at(s, 0.75)))
        low = mean(F.filter(s, lambda x: x <= at(s, 0.25)))
        return F.array(mean(s) / 255, deviation(s) / 64, high / F.greatest(low, F.lit(1.0)) / 8)

    return let(F.sort_array(F.transform(a, lambda x: x.cast("double"))), of)
