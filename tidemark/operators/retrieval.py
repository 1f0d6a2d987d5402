"""Exact nearest earlier rows, by a metric index over pivots and epochs, and the background that they predict.

Rows are sorted by (block, order) in ranges and cut into epochs of a fixed number of rows; an epoch's rows lie in cells by their
nearest pivot. A row first meets its own epoch and the one before, which bounds the distance of its k-th match. Two cells of
other epochs are compared only where the intervals of their distances to the pivots come closer than that bound (the triangle
inequality), and within such a pair only the rows that do so themselves. Results are exact for any pivots; these decide how
many pairs are tested.

Consecutive epochs are packed into units, one row each, and vectors travel by units, whatever the number of cells that are
compared: a unit goes to each later unit of its block that has a cell to compare with it. A task keeps the k closest of one unit
while the others pass. Squared distances come from products of 32-bit matrices with a bound on their error; what that bound
leaves is measured exactly, by differences.

Of rows with one vector the k first stand for the others: a row that is later than k equals of smaller ids is among no row's k
closest, so it only asks. Groups of copies, however large, therefore make no pairs among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import grid as G
from tidemark.sources.storage import drop, scratch_path, settings

#: Rows of an epoch, epochs of a unit, pivots, rows that pivots are chosen from, parts that a block's pairs of cells are dealt
#: to, and numbers of a slice of differences or of a product.
EPOCH, UNIT, PIVOTS, POOL, SALTS, SLICE = 1024, 16, 16, 256, 16, 1 << 21
#: A k-th match is far beyond so many times the cell's median.
WIDE = 2.0
#: Groups of copies that are broadcast; more are met by a shuffled join.
BROADCAST_GROUPS = 100_000
#: Shuffle files go with the job that writes a table.
WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A row is two units, so one is sent to Python at a time.
ONE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}

_CELL = "b string, pack long, epoch long, earlier long, n int, offers int, omin long, omax long, lo array<double>, hi array<double>, bound double"
_CELL_ARROW = pa.list_(pa.struct([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[t]) for c, t in (x.split() for x in _CELL.split(", "))]))
#: A unit's rows by cell. match, distance: the k closest of each row so far, infinite where there are fewer.
_BLOBS = ("ids", "orders", "vectors", "spare", "bounds", "match", "distance")
_UNITS = f"unit long, {', '.join(f'{c} binary' for c in _BLOBS)}, cells array<struct<{_CELL.replace(' ', ':').replace(',:', ',')}>>"
_FOUND = "id long, match long, distance double"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b, by differences, in slices."""
    out = np.empty((len(a), len(b)))
    step = max(1, SLICE // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _apart(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows i of a from the rows j of b, pair by pair, in slices."""
    out = np.empty(len(i))
    step = max(1, SLICE // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        d = a[i[s : s + step]] - b[j[s : s + step]]
        out[s : s + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _rounded(d: np.ndarray, digits: int | None) -> np.ndarray:
    """Distances to so many places, halves up; as they are without digits."""
    if digits is None:
        return d
    x = d * 10.0**digits
    return np.where(x < 2.0**52, np.floor(x + 0.5) / 10.0**digits, d)


def _slack(bound, digits: int | None = None):
    """A bound with room for rounding; comparisons with it let too much through, never too little."""
    return bound * (1 + 1e-9) + 1e-9 + (0.0 if digits is None else 10.0**-digits)


def _choose(pool: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` pivots, each the farthest from those before it."""
    chosen = [0]
    near = _distances(pool, pool[:1])[:, 0]
    while len(chosen) < min(count, len(pool)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(pool, pool[chosen[-1:]])[:, 0])
    return pool[chosen]


class _Products:
    """Squared distances of the rows of q and x, in units of `scale` squared, by matrix products; `error` bounds what they are
    wrong by. The scale makes all norms at most 1, so nothing overflows and what underflows is far below the error."""

    def __init__(self, q: np.ndarray, x: np.ndarray, centre: np.ndarray):
        q, x = q - centre, x - centre
        most = max(np.sqrt(np.einsum("ij,ij->i", v, v)).max(initial=0.0) for v in (q, x))
        self.scale = 2.0 ** np.ceil(np.log2(most)) if most > 0 else 1.0
        self.q, self.x = q / self.scale, x / self.scale
        self.left, self.right = self._sides(np.float32)
        self.error = self._error(np.float32)

    def _error(self, kind: type) -> float:
        return 8 * (self.q.shape[1] + 8) * float(np.finfo(kind).eps)

    def _sides(self, kind: type, i=slice(None), j=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        q, x = self.q[i], self.x[j]
        one = lambda v: np.ones((len(v), 1))
        norm = lambda v: np.einsum("ij,ij->i", v, v)[:, None]
        return np.hstack([-2 * q, norm(q), one(q)]).astype(kind), np.hstack([x, one(x), norm(x)]).astype(kind)

    def limit(self, distance: np.ndarray, error: float) -> np.ndarray:
        return (distance / self.scale) ** 2 + error

    def near(self, i: np.ndarray, j: np.ndarray | slice, k: int, bound: np.ndarray, allowed: np.ndarray | None, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the pairs of rows i of q and j of x that may be no farther apart than the bound of i, or among the k
        nearest that are allowed where this is infinite. allowed: pairs that count, or None for all."""
        for kind in (np.float32, np.float64):
            if kind is np.float32:
                left, right, error = self.left[i], self.right[j], self.error
            else:  # many pairs lie within the error, as those of rows that are close beside the farthest
                (left, right), error = self._sides(kind, i, j), self._error(kind)
            product = left @ right.T
            if allowed is not None:
                product[~allowed] = np.inf
            most = self.limit(_slack(bound, digits), error)
            open_ = np.flatnonzero(np.isinf(most))
            if len(open_) and product.shape[1] >= k:
                kth = np.partition(product[open_], k - 1, axis=1)[:, k - 1].astype(float)
                most[open_] = self.limit(_slack(np.sqrt(np.maximum(kth + error, 0)) * self.scale, digits), error)
            row, column = np.divmod(np.flatnonzero(product <= most[:, None].astype(kind) * (1 + np.finfo(kind).eps)), product.shape[1])
            if len(row) <= max(product.size // 16, 64 * len(product)):
                break
        if allowed is not None:
            counts = allowed[row, column]
            row, column = row[counts], column[counts]
        return row, column


def _least(k: int, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the k least by (d, id) of each row, row by row, and the rank of each among them."""
    order = np.lexsort((ids, d, row))
    sorted_ = row[order]
    rank = np.arange(len(row)) - np.searchsorted(sorted_, sorted_)
    return order[rank < k], rank[rank < k]


def _pack(pivots: np.ndarray, k: int, lag: int, size: int, digits: int | None):
    """Batches of (b, o, id, spare, v) in order -> units. Memory is a unit and two epochs, whatever a block's rows."""
    centre = pivots.mean(axis=0)

    def closed(epoch: int, b: str, own: tuple, before: tuple | None) -> tuple[tuple, list[dict]]:
        """An epoch's rows by cell, as the columns of a unit, and its cells."""
        orders, ids, spare, v = own
        met = own if before is None else [np.concatenate([x, y]) for x, y in zip(before[1], own, strict=True)]
        earlier = met[0][None, :] <= orders[:, None] - lag
        row, column = _Products(v, met[3], centre).near(np.arange(len(v)), slice(None), k, np.full(len(v), np.inf), earlier, digits)
        d = _rounded(_apart(v, row, met[3], column), digits)
        kth = np.full(len(v), np.inf)  # rows that only ask count: the k they stand behind are as near
        at, rank = _least(k, row, d, met[1][column])
        kth[row[at[rank == k - 1]]] = d[at[rank == k - 1]]
        match, distance = np.zeros((len(v), k), np.int64), np.full((len(v), k), np.inf)
        offered = np.flatnonzero(~met[2][column])
        at, rank = _least(k, row[offered], d[offered], met[1][column[offered]])
        match[row[offered[at]], rank], distance[row[offered[at]], rank] = met[1][column[offered[at]]], d[offered[at]]
        to = _distances(v, pivots)
        cell = 2 * to.argmin(axis=1)
        for c in np.unique(cell):  # rows whose k-th match is far for their cell, or not there yet, lie in a cell of their own
            at = np.flatnonzero(cell == c)
            cell[at[(kth[at] > WIDE * np.median(kth[at])) | np.isinf(kth[at])]] += 1
        by = np.argsort(cell, kind="stable")
        cells = []
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            cells.append({
                "b": b, "pack": epoch * 2 * len(pivots) + int(c), "epoch": epoch, "earlier": epoch if before is None else before[0], "n": len(at), "offers": int((~spare[at]).sum()), "omin": int(orders[at].min()), "omax": int(orders[at].max()),
                "lo": to[at].min(axis=0).tolist(), "hi": to[at].max(axis=0).tolist(), "bound": float(kth[at].max()),
            })
        return tuple(x[by] for x in (ids, orders, v, spare, kth, match, distance)), cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        epoch, b, held, before = TaskContext.get().partitionId() << 32, None, [], None
        unit: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, orders, v, spare, kth, match, distance = (np.concatenate([u[0][c] for u in unit]) for c in range(len(_BLOBS)))
            v = single if ((single := v.astype(np.float32)) == v).all() else v
            cells = [c for u in unit for c in u[1]]
            row = [cells[0]["epoch"], *(x.tobytes() for x in (ids, orders, v, spare, kth, match, distance))]
            kinds = [pa.int64()] + [pa.binary()] * len(_BLOBS)
            unit.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(row, kinds, strict=True)), pa.array([cells], _CELL_ARROW)], ["unit", *_BLOBS, "cells"])

        def close():
            nonlocal epoch, held, before
            if held:
                own = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                unit.append(closed(epoch, b, own, before))
                before = (epoch, own)
                epoch, held = epoch + 1, []

        for batch in batches:
            blocks = np.array(batch.column(0).to_pylist(), object)
            orders, ids, spare = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            v = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
            edges = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(ids)])).tolist()
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if first < last and blocks[first] != b:
                    close()
                    if unit:
                        yield out()
                    b, before = blocks[first], None
                while first < last:
                    n = min(last - first, size - sum(len(h[0]) for h in held))
                    held.append((orders[first : first + n], ids[first : first + n], spare[first : first + n].astype(bool), v[first : first + n]))
                    first += n
                    if sum(len(h[0]) for h in held) == size:
                        close()
                        if len(unit) == UNIT:
                            yield out()
        close()
        if unit:
            yield out()

    return run


class _Unit:
    """A unit's rows and cells as arrays."""

    def __init__(self, row: pa.RecordBatch, side: str, pivots: np.ndarray, k: int):
        read = lambda c, kind: np.frombuffer(row[f"{side}_{c}"][0].as_buffer(), kind)
        cells = row[f"{side}_cells"].flatten()
        field = lambda c: cells.field(c).to_numpy(zero_copy_only=False)
        self.ids, self.orders, self.spare = read("ids", np.int64), read("orders", np.int64), read("spare", bool)
        n = len(self.ids)
        width = len(row[f"{side}_vectors"][0].as_buffer()) // max(n * pivots.shape[1], 1)
        self.v = read("vectors", np.float32 if width == 4 else float).astype(float).reshape(n, -1)
        self.pack, self.n, self.offers, self.epoch, self.earlier, self.omin, self.omax = (field(c) for c in ("pack", "n", "offers", "epoch", "earlier", "omin", "omax"))
        self.lo, self.hi = (cells.field(c).flatten().to_numpy().reshape(len(cells), -1) for c in ("lo", "hi"))
        if side == "q":
            self.bounds = read("bounds", float).copy()
            self.match, self.distance = read("match", np.int64).reshape(n, k).copy(), read("distance", float).reshape(n, k).copy()
            self.met, self.asked = np.zeros((n, k), bool), False  # which of these come from units met here; whether its own is among them
            self.to, self.starts = _distances(self.v, pivots), np.concatenate(([0], np.cumsum(self.n)))


def _compare(pivots: np.ndarray, k: int, lag: int, digits: int | None):
    """Rows of two units each -> of the k closest of each q's rows among their own epochs and the x that it meets in a row,
    those in these x; what the epochs found themselves comes with the pair of a unit with itself, so nothing comes twice."""
    centre = pivots.mean(axis=0)

    def meet(q: _Unit, reach: np.ndarray, x: _Unit) -> None:
        gap = np.full((len(q.n), len(x.n)), -np.inf)
        for p in range(len(pivots)):
            np.maximum(gap, np.maximum(x.lo[None, :, p] - q.hi[:, None, p], q.lo[:, None, p] - x.hi[None, :, p]), out=gap)
        bound = np.minimum(np.maximum.reduceat(q.bounds, q.starts[:-1]), reach)
        met = (x.epoch != q.epoch[:, None]) & (x.epoch != q.earlier[:, None]) & (x.omin <= q.omax[:, None] - lag) & (x.offers > 0)
        near = met & (gap <= _slack(bound, digits)[:, None])
        if not near.any():
            return
        ids, orders, v = (a[~x.spare] for a in (x.ids, x.orders, x.v))
        products, starts = _Products(q.v, v, centre), np.concatenate(([0], np.cumsum(x.offers)))
        for c in np.flatnonzero(near.any(axis=1)):
            rows, cells = np.arange(q.starts[c], q.starts[c + 1]), np.flatnonzero(near[c])
            if len(cells) < len(x.n):
                own = np.minimum(q.bounds[rows], reach[c])
                apart = np.full((len(rows), len(cells)), -np.inf)
                for p in range(len(pivots)):
                    np.maximum(apart, np.maximum(x.lo[None, cells, p] - q.to[rows, None, p], q.to[rows, None, p] - x.hi[None, cells, p]), out=apart)
                close = apart <= _slack(own, digits)[:, None]
                rows, cells = rows[close.any(axis=1)], cells[close.any(axis=0)]
                if not len(rows):
                    continue
            columns = slice(None) if len(cells) == len(x.n) else np.concatenate([np.arange(starts[e], starts[e + 1]) for e in cells])
            there = orders[columns]
            step = max(1, SLICE // len(there))
            for s in range(0, len(rows), step):
                i = rows[s : s + step]
                own = np.minimum(q.bounds[i], reach[c])
                latest = q.orders[i] - lag
                allowed = None if there.max() <= latest.min() else there[None, :] <= latest[:, None]
                row, column = products.near(i, columns, k, own, allowed, digits)
                if len(row):
                    column = column if isinstance(columns, slice) else columns[column]
                    merged(q, i, row, ids[column], _rounded(_apart(q.v, i[row], v, column), digits))

    def merged(q: _Unit, i: np.ndarray, row: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """The k closest of rows i of q with so many more candidates."""
        asked, row = np.unique(row, return_inverse=True)
        i = i[asked]
        held, place = np.nonzero(np.isfinite(q.distance[i]))
        was = i[held], place
        row, ids, d, met = (np.concatenate(c) for c in ((held, row), (q.match[was], ids), (q.distance[was], d), (q.met[was], np.ones(len(row), bool))))
        at, rank = _least(k, row, d, ids)
        to = i[row[at]], rank
        q.match[to], q.distance[to], q.met[to] = ids[at], d[at], met[at]
        q.bounds[i] = np.minimum(q.bounds[i], q.distance[i, k - 1])

    def found(q: _Unit) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(q.distance) & (q.met | q.asked))
        return pa.RecordBatch.from_arrays([pa.array(q.ids[row]), pa.array(q.match[row, place]), pa.array(q.distance[row, place])], [c.split()[0] for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, q, reach = None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                if row["q"][0].as_py() != unit:
                    if q is not None:
                        yield found(q)
                    unit, q = row["q"][0].as_py(), _Unit(row, "q", pivots, k)
                    told = {r["pack"]: r["reach"] for r in row["reach"][0].as_py() or ()}
                    reach = np.array([told.get(p, np.inf) for p in q.pack.tolist()])
                q.asked |= row["x"][0].as_py() == unit
                meet(q, reach, _Unit(row, "x", pivots, k))
        if q is not None:
            yield found(q)

    return run


class Index:
    """The index of the rows' vectors. Keys are unique longs, orders longs, vectors of one length and finite; rows with a null among
    these take no part, extra columns don't either. Null blocks are a block of their own. digits: distances are rounded to so
    many places before they are compared, so that of rows that agree in them the smaller keys are nearer.

    `units` holds a row for each run of UNIT epochs, `cells` the sums of each cell, `planned` the pairs of units that are
    compared after the epochs themselves, with the pairs of rows of the cells that come close enough. Equal vectors are told
    by 128 bits of hashes."""

    def __init__(self, rows: DataFrame, vector: str, block: list[str], order: str, key: str, k: int, lag: int = 1, size: int = EPOCH, pivots: int = PIVOTS, digits: int | None = None):
        self.k, self.lag, self.digits = k, lag, digits
        spark = rows.sparkSession
        self.path = path = scratch_path(spark, "retrieval")
        kind = "array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>"
        own = rows.select(F.to_json(F.struct(*block)).alias("b") if block else F.lit("").alias("b"), F.col(order).cast("long").alias("o"), F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
        own = own.where("o IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
        with settings(spark, WRITTEN):
            own.write.parquet(f"{path}/rows")
            own = spark.read.schema(f"b string, o long, id long, v {kind}").parquet(f"{path}/rows")
            n_rows = own.count()
            pool = [r.v for r in own.select("v", "id").orderBy(F.xxhash64("v"), "id").limit(POOL).collect()]
            self.pivots = _choose(np.array(pool, dtype=float), pivots) if pool else np.zeros((1, 1))
            same = ["b", "h1", "h2"]
            hashed = own.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
            first = hashed.select(*same, "o", "id").withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy("o", "id"))).where(F.col("place") <= k)
            first.groupBy(*same).agg(F.max("id").alias("last"), F.max("o").alias("since"), F.count("*").alias("n")).where(F.col("n") == k).drop("n").write.parquet(f"{path}/ahead")
            ahead = spark.read.schema("b string, h1 long, h2 long, last long, since long").parquet(f"{path}/ahead")
            ahead = F.broadcast(ahead) if ahead.count() <= BROADCAST_GROUPS else ahead
            spare = F.coalesce((F.col("o") >= F.col("since")) & (F.col("id") > F.col("last")), F.lit(False))
            told = hashed.join(ahead, same, "left").select("b", "o", "id", spare.alias("spare"), "v")
            parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // (size * UNIT))))  # fewer rows than a unit's would be sent more often
            ranged = told.repartitionByRange(parts, "b", "o", "id").sortWithinPartitions("b", "o", "id")
            ranged.mapInArrow(_pack(self.pivots, k, lag, size, digits), _UNITS).write.parquet(f"{path}/units")
            drop(spark, f"{path}/rows")
            self.units = spark.read.schema(_UNITS).parquet(f"{path}/units")
            self.cells = self.units.select("unit", F.inline("cells"))
            reach, planned = self._plan()
            self.planned = spark.read.schema("q long, x long, rows long").parquet(planned)
            self.reach = spark.read.schema("unit long, pack long, reach double").parquet(reach)

    def _plan(self) -> tuple[str, str]:
        """Folders of the bounds of cells of far matches, and of pairs of units, by the sums of their cells alone. A block's
        cells are dealt to SALTS parts, so a hot block is no single task."""
        names = ("unit", "b", "pack", "epoch", "earlier", "n", "offers", "omin", "omax", "lo", "hi", "bound")
        q = self.cells.select(*[F.col(c).alias(f"q_{c}") for c in names], F.pmod(F.xxhash64("pack"), F.lit(SALTS)).alias("salt"))
        x = self.cells.select(*[F.col(c).alias(f"x_{c}") for c in names], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")).where("x_offers > 0")
        every = range(len(self.pivots))
        same = (F.col("q_b") == F.col("x_b")) & (q["salt"] == x["salt"])
        # a cell of far matches: k rows of one earlier cell are nearer than by way of any pivot
        far = F.least(*[F.col("q_hi")[p] + F.col("x_hi")[p] for p in every], F.lit(float("inf")))
        whole = (F.col("x_offers") >= self.k) & (F.col("x_omax") <= F.col("q_omin") - self.lag)
        q.where("q_pack % 2 = 1").join(x, same & whole).groupBy(F.col("q_unit").alias("unit"), F.col("q_pack").alias("pack")).agg(F.min(far).alias("reach")).write.parquet(f"{self.path}/reach")
        reach = self.cells.sparkSession.read.schema("unit long, pack long, reach double").parquet(f"{self.path}/reach").drop("unit")
        bounded = q.join(reach, F.col("q_pack") == F.col("pack"), "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        gap = F.greatest(*[F.greatest(F.col("x_lo")[p] - F.col("q_hi")[p], F.col("q_lo")[p] - F.col("x_hi")[p]) for p in every], F.lit(0.0))
        met = (F.col("x_epoch") != F.col("q_epoch")) & (F.col("x_epoch") != F.col("q_earlier")) & (F.col("x_omin") <= F.col("q_omax") - self.lag)
        near = gap <= _slack(F.least("q_bound", "reach"), self.digits)
        pairs = bounded.join(x, same & met & near).groupBy(F.col("q_unit").alias("q"), F.col("x_unit").alias("x"))
        pairs.agg(F.sum(F.col("q_n").cast("long") * F.col("x_offers")).alias("rows")).write.parquet(f"{self.path}/planned")
        return f"{self.path}/reach", f"{self.path}/planned"

    def matches(self) -> DataFrame:
        """(id, match, distance, place): the k nearest rows of each row's block whose order is at least `lag` smaller, by
        (distance, match); fewer where there are fewer."""
        spark = self.units.sparkSession
        side = lambda s, names: self.units.select(F.col("unit").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in names])
        own = self.units.select(F.col("unit").alias("q"), F.col("unit").alias("x"))
        pairs = self.planned.select("q", "x").unionByName(own).distinct()
        reach = self.reach.groupBy(F.col("unit").alias("q")).agg(F.collect_list(F.struct("pack", "reach")).alias("reach"))
        met = pairs.join(side("x", ("ids", "orders", "vectors", "spare", "cells")), "x")
        both = met.join(side("q", (*_BLOBS, "cells")).join(reach, "q", "left"), "q").sortWithinPartitions("q")
        path = scratch_path(spark, "matches")
        with settings(spark, WRITTEN | ONE):
            both.mapInArrow(_compare(self.pivots, self.k, self.lag, self.digits), _FOUND).write.parquet(path)
        found = spark.read.schema(_FOUND).parquet(path)
        place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "match"))
        return found.select("*", place.alias("place")).where(F.col("place") <= self.k)


def nearest_past(rows: DataFrame, vector: str, block: list[str], order: str, key: str, k: int, lag: int = 1, digits: int | None = None) -> DataFrame:
    """The k most similar earlier rows of each row's block, by (distance, key); see Index."""
    return Index(rows, vector, block, order, key, k, lag, digits=digits).matches()


def retrieved(matches: DataFrame, grids: DataFrame, key: str, tile: str, cells: int, scale: float = 1.4826) -> DataFrame:
    """(id, members, median, mad): cell by cell the median and scaled median deviation of the grids that each row's matches name.
    A row's matches are few (the k of the search), so they fit in its row; rows without matches have none here."""
    joined = matches.join(grids.select(F.col(key).alias("match"), F.col(tile).alias("__tile")), "match")
    held = joined.groupBy("id").agg(F.count("*").alias("members"), F.collect_list("__tile").alias("__tiles"))
    places = F.sequence(F.lit(0), F.lit(cells - 1))
    median = F.transform(places, lambda i: G.median(F.transform("__tiles", lambda t: t[i])))
    modelled = held.withColumn("median", median)
    mad = F.transform(places, lambda i: G.median(F.transform("__tiles", lambda t: F.abs(t[i] - F.col("median")[i]))) * scale)
    return modelled.select("id", "members", "median", mad.alias("mad"))
