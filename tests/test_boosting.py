"""Boosting over histograms against trees grown row by row."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import boosting, fitting
from tidemark.operators import suppression as S
from tidemark.operators.boosting import BoostConfig

SF = "/root/testdata/sf0.001"


class SlowTrees:
    """The same trees from values instead of bins: each node tries each middle between two of its table's values."""

    def __init__(self, x, y, c, cuts=None):
        self.c, self.trees, self.steps = c, [], 1 << 26
        self.cuts = cuts or [(lambda v: [(a + b) / 2 for a, b in zip(v, v[1:])])(sorted({float(t) for t in x[:, f] if t == t})) for f in range(x.shape[1])]
        share = y.mean()
        self.base = math.log(share / (1 - share))
        raw = np.full(len(y), self.base)
        for _ in range(c.rounds):
            p = 1 / (1 + np.exp(-raw))
            g = np.where(y > 0.5, -np.rint((1 - p) * self.steps), np.rint(p * self.steps))
            h = np.rint(p * (1 - p) * self.steps)
            self.trees.append(self.grow(x, g, h, np.arange(len(y)), c.depth))
            raw = raw + np.array([self.walk(self.trees[-1], r) for r in x])

    def grow(self, x, g, h, own, depth):
        best, found = 0.0, None
        lost = lambda s: g[s].sum() / max(h[s].sum(), 1) * g[s].sum()
        for f in range(x.shape[1]) if depth else ():
            gone = np.isnan(x[own, f])
            for left_missing in (True, False):
                for cut in [*self.cuts[f], math.inf]:
                    left = np.where(gone, left_missing, x[own, f] <= cut)
                    a, b = own[left], own[~left]
                    if min(len(a), len(b)) < self.c.least_rows or min(h[a].sum(), h[b].sum()) < self.c.least_curvature * self.steps:
                        continue
                    fall = lost(a) + lost(b) - lost(own)
                    if fall > best:
                        best, found = fall, (f, cut, left_missing, a, b)
        if found is None:
            return -self.c.rate * g[own].sum() / max(h[own].sum(), 1)
        f, cut, left_missing, a, b = found
        return f, cut, left_missing, self.grow(x, g, h, a, depth - 1), self.grow(x, g, h, b, depth - 1)

    def walk(self, tree, r):
        while isinstance(tree, tuple):
            f, cut, left_missing, a, b = tree
            tree = a if (left_missing if math.isnan(r[f]) else r[f] <= cut) else b
        return tree

    def score(self, r):
        return 1 / (1 + math.exp(-(self.base + sum(self.walk(t, r) for t in self.trees))))


def rows(n, seed, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 30, n) / 7, rng.integers(0, 4, n)], axis=1).astype(float)
    y = (rng.random(n) < 0.1 + 0.5 * (x[:, 0] > 4) + 0.3 * (x[:, 1] * x[:, 2] > 5)).astype(float)
    x[rng.random(x.shape) < gaps] = math.nan
    return x, y


def frame(spark, x, y, fold=None):
    value = lambda v, k: None if math.isnan(v) and k % 2 else float(v)  # noqa: E731 - nulls and NaN are missing alike
    data = [(k, *[value(v, k) for v in r], float(t), int(k // 10) % 3 if fold is None else fold) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double, fold int").repartition(5)


def test_trees_of_all_rows(spark):
    x, y = rows(260, 1)
    c = BoostConfig(rounds=13, rate=0.3)
    df = frame(spark, x, y)
    got = {r.id: r.score for r in fitting.boosted(df, ["a", "b", "c"], "y", c)(df).collect()}
    slow = SlowTrees(x, y, c)
    assert all(got[k] == pytest.approx(slow.score(r), abs=1e-12) for k, r in enumerate(x))
    assert sum(isinstance(t, tuple) for t in slow.trees) == 13 and np.ptp(list(got.values())) > 0.5


def test_models_of_folds_grow_side_by_side(spark, monkeypatch):
    x, y = rows(200, 2, gaps=0.3)
    c = BoostConfig(rounds=6, rate=0.2, depth=2, least_rows=10)
    df = frame(spark, x, y)
    wide, apart = (boosting.fit(df, ["a", "b", "c"], "y", "fold", 3, c), monkeypatch.setattr(boosting, "PART", 40))[0], boosting.fit(df, ["a", "b", "c"], "y", "fold", 3, c)
    for one, other in zip(wide, apart, strict=True):  # however many partitions
        assert all((s.value == t.value).all() and (s.feature == t.feature).all() for s, t in zip(one.trees, other.trees, strict=True))
    scores = {r.id: r.s for r in df.select("id", boosting.score(wide, [F.col(n) for n in "abc"], F.col("fold")).alias("s")).collect()}
    cuts = SlowTrees(x, y, BoostConfig(rounds=0)).cuts
    for f in range(3):
        out = np.array([k // 10 % 3 == f for k in range(200)])
        slow = SlowTrees(x[~out], y[~out], c, cuts)
        assert all(scores[k] == pytest.approx(slow.score(x[k]), abs=1e-12) for k in np.flatnonzero(out))


def test_bins_of_many_values_hold_equal_parts(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    (edges,) = boosting.bin_edges(spark.createDataFrame([(float(t),) for t in v] + [(None,), (math.nan,)], "v double"), ["v"], 16)
    assert 8 <= len(edges) <= 15 and set(edges) <= set(v) and edges[-1] < v.max()
    sizes = np.bincount(np.searchsorted(edges, v[v != 0.25], side="left"))
    assert sizes.max() <= 4500 / 16 + 1  # only the repeated value fills more than its part
    with pytest.raises(ValueError):
        boosting.bin_edges(spark.createDataFrame([(1.0,), (math.inf,)], "v double"), ["v"], 16)


def test_odd_tables(spark):
    x, y = rows(60, 4)
    c = BoostConfig(rounds=3)
    df = frame(spark, x, y, 0)
    got = lambda train: {round(r.score, 9) for r in fitting.boosted(train, ["a", "b", "c"], "y", c)(df).collect()}
    assert got(df.where("false")) == {0.001} and got(df.withColumn("y", F.lit(1.0))) == {0.999} and got(df.withColumn("y", F.lit(0.0))) == {0.001}
    assert got(df.withColumn("y", F.lit(None).cast("double"))) == {0.001}
    unknown = boosting.score(boosting.fit(df, ["a", "b", "c"], "y", c=c), [F.col(n) for n in "abc"], F.lit(None).cast("int"))
    assert {r[0] for r in df.select(unknown).collect()} == {None}
    for none in ("a", "b", "c"):  # a feature without values splits nothing
        df = df.withColumn(none, F.lit(None).cast("double"))
    (only,) = got(df)
    assert only == pytest.approx(y.mean(), abs=1e-8)


def test_out_of_fold_scores_of_the_whole_table(spark, monkeypatch):
    from tidemark.plans import fitting as plans

    monkeypatch.setattr(plans, "BOOST", BoostConfig(rounds=8, bins=10_000))
    got = registry.queries()["out_of_fold_scores"](spark, SF).toPandas()
    events = plans._events(spark, SF).toPandas().set_index("id")
    x, y = events[["elevation", "gap", "burst"]].to_numpy(float), events["hit"].to_numpy()
    fold = got.set_index("id")["fold"].reindex(events.index).to_numpy()
    cuts = SlowTrees(x, y, BoostConfig(rounds=0)).cuts
    assert len(got) == len(events) > 300
    found = got.set_index("id")["score"].reindex(events.index).to_numpy()
    own = fold == 0
    slow = SlowTrees(x[~own], y[~own], plans.BOOST, cuts)
    assert np.allclose(found[own], [slow.score(r) for r in x[own]], atol=1e-12)


def test_distilled_table_and_gate(spark, monkeypatch):
    from tidemark.plans import fitting as plans
    from tidemark.plans.suppression import centroids

    monkeypatch.setattr(plans, "BOOST", BoostConfig(rounds=8, bins=10_000))
    events = plans._events(spark, SF).toPandas()
    slow = SlowTrees(events[["elevation", "gap", "burst"]].to_numpy(float), events["hit"].to_numpy(), plans.BOOST)
    score = lambda rows: [round(slow.score(r), 9) for r in rows[["elevation", "gap", "burst"]].to_numpy(float)]
    cells = centroids(spark).toPandas()
    cells["s"] = score(cells)
    ranks = {s: k for k, s in enumerate(sorted(set(cells["s"])))}
    want = {int(r.cell): round(ranks[r.s] * 255 / max(len(ranks) - 1, 1)) for r in cells.itertuples()}
    assert len(ranks) > 3 and {r.cell: r.score for r in registry.queries()["distilled_table"](spark, SF).collect()} == want

    def zero_loss(scores):
        least = min((s for s, hit in zip(scores, events["hit"], strict=True) if hit > 0.5), default=None)
        return sum(s < least for s in scores) / len(scores) if least is not None else 1.0

    by_cell = dict(zip(cells["cell"], cells["s"], strict=True))
    own = plans._events(spark, SF).select("id", S.cell(F.col("elevation"), F.col("gap"), F.col("burst").cast("int")).alias("cell")).toPandas().set_index("id")["cell"]
    tabled, whole = zero_loss([by_cell[own[i]] for i in events["id"]]), zero_loss(score(events))
    (row,) = registry.queries()["table_gate"](spark, SF).collect()
    assert (row.table_zero_loss, row.model_zero_loss, row.ships) == (pytest.approx(tabled), pytest.approx(whole), tabled >= 0.85 * whole)


def test_rows_are_computed_once_and_cells_are_told_apart_by_bins_alone(spark, tmp_path, monkeypatch):
    x, y = rows(300, 5)

    def seen(batches):
        (tmp_path / str(time.time_ns())).touch()
        yield from batches

    df = frame(spark, x, y).coalesce(1)
    df = df.mapInPandas(seen, df.schema)
    found = []
    monkeypatch.setattr(boosting, "_grow", lambda spark, cells, *_: found.append(cells.count()))
    boosting.fit(df, ["a", "b", "c"], "y", "fold", 3, BoostConfig(rounds=1))
    assert len(list(tmp_path.iterdir())) == 1
    assert found == [len({tuple(-1.0 if t != t else t for t in r) for r in x.tolist()})]
