"""First-order recurrences over ordered rows, as parallel scans.

y' = max(p y + q, c), with p >= 0, takes in running means, decayed sums and variances with a floor. Such maps are closed under
composition: after (p, q, c), a second map gives max(p2 p y + p2 q + q2, max(p2 c + q2, c2)). So a key's history needs no
single task: rows are cut into ranges of (key, order), each range composes its maps from its own start, the states in which
ranges begin follow from one row for each range, and each row's state is its composed map of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.background import EmaConfig
from tidemark.sources.storage import scratch_path

NO_FLOOR = -float("inf")


def after(first: tuple, second: tuple) -> tuple:
    """The map that does `first` and then `second`."""
    (p1, q1, c1), (p2, q2, c2) = first, second
    with np.errstate(invalid="ignore"):
        floor = np.where(np.isneginf(c1), NO_FLOOR, p2 * c1 + q2)
    return p2 * p1, p2 * q1 + q2, np.maximum(floor, c2)


def prefixes(maps: tuple[np.ndarray, np.ndarray, np.ndarray], new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The composition of the maps from the last row before or at each that `new` marks, by doubling: log n vector steps."""
    p, q, c = (m.copy() for m in maps)
    n, step = len(p), 1
    place = np.arange(n)
    left = place - np.maximum.accumulate(np.where(new, place, 0))  # rows before this one in its stretch
    while step < n:
        at = np.flatnonzero(left >= step)
        if not len(at):
            break
        p[at], q[at], c[at] = after((p[at - step], q[at - step], c[at - step]), (p[at], q[at], c[at]))
        step *= 2
    return p, q, c


def _compose(columns: int):
    """Batches of (key, p, q, c, ...) in order -> with part, first (whether no other key came before in the part) and the map
    (before_p, before_q, before_c) of the key's rows before in the part. Memory is a batch, whatever a key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, carry, first, started = TaskContext.get().partitionId(), None, (1.0, 0.0, NO_FLOOR), True, False
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = batch.column(0)
            new = np.zeros(n, bool)
            new[1:] = _differ(keys)
            new[0] = started and keys[0].as_py() != key
            maps = tuple(np.asarray(batch.column(k), float) for k in (1, 2, 3))
            if not started or new[0]:
                carry = (1.0, 0.0, NO_FLOOR)
            marks = new.copy()
            marks[0] = True
            own = prefixes(maps, marks)
            stretch = np.cumsum(new) - new[0]
            head = np.flatnonzero(stretch == 0)
            p, q, c = (m.copy() for m in own)
            p[head], q[head], c[head] = after(tuple(np.full(len(head), x) for x in carry), tuple(m[head] for m in own))
            # each row's own map is left out: what holds before it is what holds after the row before
            before = [np.concatenate(([x], m[:-1])) for x, m in zip(carry, (p, q, c), strict=True)]
            opens = np.flatnonzero(marks) if new[0] else np.flatnonzero(marks)[1:]
            for m, x in zip(before, (1.0, 0.0, NO_FLOOR), strict=True):
                m[opens] = x
            firsts = np.full(n, first) & (np.cumsum(new) == 0)
            first = bool(firsts[-1])
            started, key, carry = True, keys[n - 1].as_py(), (float(p[-1]), float(q[-1]), float(c[-1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(columns)), pa.array(np.full(n, part, np.int32)), pa.array(firsts), *map(pa.array, before)], [*batch.schema.names, "__part", "__first", "__p", "__q", "__c"])

    return run


def _differ(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first differs from the one before; null equals null."""
    one, two = keys.slice(1), keys.slice(0, len(keys) - 1)
    return pc.if_else(pc.or_(one.is_null(), two.is_null()), pc.xor(one.is_null(), two.is_null()), pc.not_equal(one, two)).to_numpy(zero_copy_only=False)


def scan(rows: DataFrame, key: str, order: list[str], p: Column, q: Column, c: Column, start: float, name: str, parts: int | None = None) -> DataFrame:
    """`rows` with before_<name> and <name>: the state of y' = max(p y + q, c) before and after each row of its key, in the
    `order`, from `start`. c is NO_FLOOR where there is none; p, q and c must not be null.

    One range shuffle by (key, order), whose sorted parts compose their maps and are written once. The driver then folds two
    rows of each part, those of its first and its last key, and a join with a row for each part, so of a size that
    the number of parts bounds, gives the states. `parts`: how many, by default as many as a shuffle has."""
    spark = rows.sparkSession
    taken = [x for x in rows.columns if x != key]
    ranged = rows.select(key, p.cast("double").alias("__own_p"), q.cast("double").alias("__own_q"), c.cast("double").alias("__own_c"), *taken)
    ordered = ranged.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), key, *order).sortWithinPartitions(key, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + ", __part int, __first boolean, __p double, __q double, __c double"
    path = scratch_path(spark, "scan")
    ordered.mapInArrow(_compose(len(ordered.columns)), schema).write.parquet(path)
    done = spark.read.schema(schema).parquet(path)
    # the map of all rows of a part's first and last key: that of its last row, with the row's own
    row = F.struct(F.col(key).alias("key"), F.col("__first").alias("first"), *[F.col(f"__{o}{x}").alias(f"{o}{x}") for o in ("", "own_") for x in "pqc"])
    ends = done.groupBy("__part").agg(F.max_by(row, F.struct(key, *order)).alias("last"), F.max_by(F.col(key), F.when(F.col("__first"), F.struct(*order))).alias("head"))
    begins, state, known = [], start, None
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        begin = state if known == (r.head,) else start
        begins.append((r["__part"], float(begin)))
        x = r.last
        p_, q_, c_ = after((x.p, x.q, x.c), (x.own_p, x.own_q, x.own_c))
        state, known = float(max(p_ * (begin if x.first else start) + q_, c_)), (x.key,)
    states = spark.createDataFrame(begins, "__part int, __begin double")
    joined = done.join(F.broadcast(states), "__part")
    before = F.greatest(F.col("__p") * F.when(F.col("__first"), F.col("__begin")).otherwise(F.lit(float(start))) + F.col("__q"), F.col("__c"))
    stated = joined.withColumn(f"before_{name}", before)
    now = F.greatest(F.col("__own_p") * F.col(f"before_{name}") + F.col("__own_q"), F.col("__own_c"))
    return stated.select(*rows.columns, f"before_{name}", now.alias(name))


def ema(rows: DataFrame, key: str, order: list[str], x: str, west: bool = False, c: EmaConfig = EmaConfig(), parts: int | None = None) -> DataFrame:
    """`rows` with mean and variance after each row of its key, and before_mean and before_variance. The variance takes the
    residual after the mean has moved, and has a floor; or, by West's estimator, before, without one."""
    a = c.alpha
    means = scan(rows, key, order, F.lit(1 - a), a * F.col(x), F.lit(NO_FLOOR), c.start_mean, "mean", parts)
    d = F.col(x) - F.col("before_mean" if west else "mean")
    grown = (1 - a) * a * d * d if west else a * d * d
    return scan(means, key, order, F.lit(1 - a), grown, F.lit(NO_FLOOR if west else c.floor), c.start_variance, "variance", parts)
