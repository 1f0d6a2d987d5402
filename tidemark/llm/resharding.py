"""Minimum-cost-flow resharding (operator 3).

Old shard sizes and new capacities make a transportation problem: bytes that stay where they are cost nothing, moved ones
cost one each (or what the caller says). Successive shortest paths solve it on the driver, over shards alone, never over
rows. Rows of an old shard lie in blocks, by a hash; the flow takes whole blocks in order, and a block that a transfer
cuts is divided row by row, largest first, each row to the part that lacks most. Only shards that gain or lose rows are
written anew.

Law: `bytes`; the new capacities differ by one byte at most, and shards follow them to within a small row.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch, free_name, with_row_key


@dataclass(frozen=True)
class ReshardConfig:
    """shards: new ones. block_bytes: aimed size of a block. blocks: most of them in all; their sizes, 24 bytes each, are
    all that the driver gets, and they grow beyond block_bytes once there are so many."""

    shards: int = 24
    block_bytes: int = 1 << 20
    blocks: int = 1 << 16


def min_cost_flow(sizes: list[int], capacities: list[int], costs: list[list[int]]) -> list[list[int]]:
    """flow[i][j], the bytes of old shard i that go to new shard j at the least total cost; capacities must hold all.

    Successive shortest paths with potentials (Dijkstra); all costs must be at least 0."""
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards can't hold all bytes")
    flow = [[0] * m for _ in range(n)]
    left, room = list(sizes), list(capacities)
    up = [0] * (n + m)
    while any(left):
        far = [float("inf")] * (n + m)
        back: list[int] = [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            far[i] = 0
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            ends = ((n + j, costs[v][j]) for j in range(m)) if v < n else ((i, -costs[i][v - n]) for i in range(n) if flow[i][v - n])
            for w, cost in ends:
                to = d + cost + up[v] - up[w]
                if to < far[w]:
                    far[w], back[w] = to, v
                    heapq.heappush(heap, (to, w))
        goal = min((j for j in range(m) if room[j]), key=lambda j: (far[n + j] + up[n + j], j))
        path = [n + goal]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        most = min(left[path[0]], room[goal], *(flow[w][v - n] for v, w in zip(path, path[1:], strict=False) if v >= n))
        for v, w in zip(path, path[1:], strict=False):
            if v < n:
                flow[v][w - n] += most
            else:
                flow[w][v - n] -= most
        left[path[0]] -= most
        room[goal] -= most
        top = max(x for x in far if x < float("inf"))
        up = [p + min(x, top) for p, x in zip(up, far, strict=True)]
    return flow


def _divide(parts: dict[tuple[int, int], list[tuple[int, int]]]):
    """Rows of a cut block, largest first, each to the shard that lacks most bytes. A block is bounded by its size, and
    rows keep their Arrow types, so ids of any size and nulls stay what they are."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("spread", "ascending")])
        heap = [(-need, shard) for shard, need in parts[table["old_shard"][0].as_py(), table["block"][0].as_py()]]
        heapq.heapify(heap)
        to = np.empty(len(table), np.int32)
        for k, size in enumerate(table["size"].to_pylist()):
            need, to[k] = heapq.heappop(heap)
            heapq.heappush(heap, (need + size, int(to[k])))
        rank = np.empty(len(to), np.int64)
        for shard in np.unique(to):
            rank[to == shard] = np.arange((to == shard).sum())
        return table.drop_columns(["spread"]).append_column("shard", pa.array(to)).append_column("rank", pa.array(rank))

    return run


COLUMNS = ("doc_id", "size", "text_crc32")
#: Rows of cut blocks are met by a broadcast of so many keys at most, beyond it by a shuffled join.
BROADCAST_KEYS = 125_000


@dataclass(frozen=True)
class Plan:
    """rows: the digest that `reshard` describes, with `key`. old_shard: the expression for it. blocks: of each old shard.
    whole: (old_shard, block, shard, base), the blocks that move or stay as one and the slot of their first row; cut: (the
    key, shard, slot) of the rows of all other blocks; None where there are none."""

    rows: DataFrame
    key: tuple[str, ...]
    old_shard: Column
    blocks: dict[int, int]
    whole: DataFrame | None
    cut: DataFrame | None


def _old(old_shard: Column) -> Column:
    return F.coalesce(old_shard.cast("int"), F.lit(0))


def _block(old: Column, spread: Column, blocks: dict[int, int]) -> Column:
    counts = F.create_map(*[x for i, n in sorted(blocks.items()) for x in (F.lit(i), F.lit(n))])
    return F.pmod(spread, counts[old]).cast("int")


def _spread(key: Sequence[str]) -> Column:
    """A hash of the row's key, or without one, of its place in this plan."""
    return F.pmod(F.xxhash64(*key) if key else F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40))


def reshard(docs: DataFrame, old_shard: Column, config: ReshardConfig = ReshardConfig(), costs: list[list[int]] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard), a row for each row of `docs`.

    old_shard: an expression over `docs` for the shard (0 and up, a few hundred at most) in which a row lies; a new shard
    of the same number is its home. costs[i][j]: of moving a byte from i to j; by default 0 at home and 1 else. size:
    UTF-8 bytes of the text, null none, plus 8. slot: the row's place in its shard, gapless from 0. grown_shard: null, as
    for any law but `key`.

    Null old shards count as shard 0. Null texts have the checksum of an empty one. Null and repeated doc_ids, and rows
    that are equal in all columns, are rows as any others. Fewer rows than shards leave shards empty. Empty table: an
    empty result.
    """
    return plan(docs, old_shard, config, costs).rows


def plan(docs: DataFrame, old_shard: Column, config: ReshardConfig = ReshardConfig(), costs: list[list[int]] | None = None, key: Sequence[str] = ()) -> Plan:
    """`reshard`, with what `rewrite` needs. `key`: columns of `docs` that tell its rows apart (see `with_row_key`); a key
    that is null or repeated is an error."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    #: Columns of `docs` under names of our own, whatever theirs are.
    keys = [f"key_{k}" for k in range(len(key))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        _old(old_shard).alias("old_shard"), _spread(key).alias("spread"), *[F.col(c).alias(k) for c, k in zip(key, keys, strict=True)],
    )
    own = [*COLUMNS, *keys]
    rows = scratch.save(rows)
    if keys and not rows.groupBy(*keys).agg(F.count("*").alias("rows_of_key")).where(F.expr(" OR ".join([f"{k} IS NULL" for k in keys] + ["rows_of_key > 1"]))).isEmpty():
        raise ValueError("the key must tell all rows apart")

    def planned(out: DataFrame, blocks: dict[int, int], whole: DataFrame | None, cut: DataFrame | None) -> Plan:
        plain = [*COLUMNS, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"]
        return Plan(out.select(*plain, *[F.col(k).alias(c) for c, k in zip(key, keys, strict=True)]), tuple(key), old_shard, blocks, whole, cut)

    old = {r.old_shard: r.bytes for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    total = sum(old.values())
    if not total:
        return planned(rows.select(*own, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), "old_shard"), {}, None, None)
    names = sorted(old)
    capacities = [(total * (j + 1)) // config.shards - (total * j) // config.shards for j in range(config.shards)]
    costs = costs or [[0 if i == j else 1 for j in range(config.shards)] for i in names]
    flow = min_cost_flow([old[i] for i in names], capacities, costs)
    aim = max(config.block_bytes, total // max(1, config.blocks - len(names)))
    counts = {i: 1 + old[i] // aim for i in names}
    rows = rows.withColumn("block", _block(F.col("old_shard"), F.col("spread"), counts))
    whole, cut = _transfers(rows, names, flow)
    starts, used = [], [0] * config.shards
    for (o, b), (shard, n) in whole.items():
        starts.append((o, b, shard, used[shard]))
        used[shard] += n
    placed = spark.createDataFrame(starts, "old_shard int, block int, shard int, base long") if starts else None
    out = split = None
    if placed is not None:
        plain = rows.join(F.broadcast(placed), ["old_shard", "block"])
        out = plain.select(*own, "shard", (F.col("base") + F.row_number().over(_in_block("old_shard", "block")) - 1).alias("slot"), "old_shard")
    if cut:
        split_blocks = spark.createDataFrame(list(cut), "old_shard int, block int")
        open_ = rows.join(F.broadcast(split_blocks), ["old_shard", "block"]).select(*own, "old_shard", "block", "spread")
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_.schema if f.name != "spread")
        divided = scratch.save(open_.groupBy("old_shard", "block").applyInArrow(_divide(cut), f"{types}, shard int, rank long"))
        bases = []
        for r in divided.groupBy("old_shard", "block", "shard").count().orderBy("old_shard", "block", "shard").collect():
            bases.append((r.old_shard, r.block, r.shard, used[r.shard]))
            used[r.shard] += r["count"]
        parts = spark.createDataFrame(bases, "old_shard int, block int, shard int, base long")
        split = divided.join(F.broadcast(parts), ["old_shard", "block", "shard"]).select(*own, "shard", (F.col("base") + F.col("rank")).alias("slot"), "old_shard")
        out = split if out is None else out.union(split)
    return planned(out, counts, placed, split)


def _in_block(*by: str):
    return Window.partitionBy(*by).orderBy("doc_id", "text_crc32", "spread")


def _transfers(rows: DataFrame, names: list[int], flow: list[list[int]]):
    """({whole block: (shard, rows)}, {cut block: [(shard, bytes)]}): the flow laid along each shard's blocks, home first."""
    blocks: dict[int, list[tuple[int, int, int]]] = {i: [] for i in names}
    for r in rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("old_shard", "block").collect():
        blocks[r.old_shard].append((r.block, r.bytes, r.n))
    whole, cut = {}, {}
    for k, i in enumerate(names):
        wants = [[j, b] for j, b in sorted(enumerate(flow[k]), key=lambda x: (x[0] != i, x[0])) if b]
        for block, size, n in blocks[i]:
            parts = []
            while size:
                take = min(size, wants[0][1])
                parts.append((wants[0][0], take))
                size -= take
                wants[0][1] -= take
                if not wants[0][1]:
                    wants.pop(0)
            if len(parts) == 1:
                whole[i, block] = (parts[0][0], n)
            else:
                cut[i, block] = parts
    return whole, cut


#: Slots of a shard whose blocks are written by one task.
PIECE = 1 << 13


def rewrite(docs: DataFrame, plan: Plan, path: str) -> list[int]:
    """Write the shards that gain or lose rows, with all columns of `docs` but the key, as Parquet under path/shard=N, in
    slot order with the slot beside them, and return their numbers; the two columns take more underscores if the documents
    have such names. A shard none of whose rows moves stays as its old files are.

    `docs` are the rows that were planned, with the plan's key. A row's block follows from its key, and the plan's table of
    blocks is small, so texts are shuffled once, to their shard. doc_ids and texts may be null or repeated, texts of any
    length. Without a row, or without a move, nothing is written.
    """
    moves = [p.select("shard", "old_shard").distinct() for p in (plan.whole, plan.cut) if p is not None]
    touched = sorted({i for m in moves for r in m.where("shard <> old_shard").collect() for i in r})
    if not touched:
        return []
    shard, slot = (free_name(docs, c) for c in ("shard", "slot"))
    columns = [c for c in docs.columns if c not in plan.key]
    whole = F.struct(*[F.col(c) for c in columns]).alias("row")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("text_crc32"), _old(plan.old_shard).alias("old_shard"), _spread(plan.key).alias("spread"), *[F.col(c).alias(f"key_{k}") for k, c in enumerate(plan.key)])
    out = []
    if plan.whole is not None:
        blocks = plan.whole.where(F.col("shard").isin(touched)).withColumn("piece", F.floor(F.col("base") / PIECE))
        placed = rows.withColumn("block", _block(F.col("old_shard"), F.col("spread"), plan.blocks)).join(F.broadcast(blocks), ["old_shard", "block"])
        dealt = placed.repartition("shard", "piece")
        at = F.row_number().over(_in_block("shard", "piece", "old_shard", "block"))
        out.append(dealt.select("row", "shard", (F.col("base") + at - 1).alias("slot")))
    if plan.cut is not None:
        few = plan.cut.count() <= BROADCAST_KEYS
        cut = plan.cut.where(F.col("shard").isin(touched)).select(*[f"key_{k}" for k in range(len(plan.key))], "shard", "slot")
        own = rows.join(F.broadcast(cut) if few else cut, [f"key_{k}" for k in range(len(plan.key))])
        out.append(own.select("row", "shard", "slot").repartition("shard", F.floor(F.col("slot") / PIECE)))
    both = out[0] if len(out) == 1 else out[0].union(out[1])
    named = both.select(*[F.col("row")[c].alias(c) for c in columns], F.col("shard").alias(shard), F.col("slot").alias(slot))
    named.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return touched


def resharded(docs: DataFrame, old_shard: Column, config: ReshardConfig = ReshardConfig()) -> DataFrame:
    """The digest of `reshard` after the affected shards were rewritten in the shared folder: size, checksum, shard and slot
    of their rows are read from the new files, those of other shards from the plan. Rows that come from no scan of files
    are written there first.

    Nulls, repeated rows and empty tables as in `reshard`.
    """
    scratch = Scratch(docs.sparkSession, "rewrite")
    keyed, key = with_row_key(docs)
    moves = plan(keyed, old_shard, config, key=key)
    path = f"{scratch.root}/shards"
    touched = rewrite(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), old_shard.alias("old"), *key), replace(moves, old_shard=F.col("old")), path)
    stayed = moves.rows.drop("old_shard", *key).where(~F.col("shard").isin(touched))
    if not touched:
        return stayed
    text = F.coalesce(F.col("text"), F.lit(""))
    files = docs.sparkSession.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    written = files.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    return stayed.union(written)
