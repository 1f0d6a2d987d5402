"""MinHash near-dedup by fast similarity sketching, banding and exact verification (operator 9).

The sketch is Dahlgaard, Knudsen and Thorup's (2017): in round i every element is thrown into a random bin with a random
value, a bin keeps its smallest (round, value); after `coordinates` rounds, round coordinates + j throws all elements into
bin j. So every coordinate fills, after an expected O(n + t log t) throws, and the share of equal coordinates estimates
the Jaccard similarity with Chernoff bounds as for t independent minhashes.

Plan: (1) sketch each text, keep its bands and a fingerprint of its shingle set; (2) fold equal sets, so copies cost one
row; (3) rounds in which every band bucket names one leader and members that aren't yet of the leader's component are
confirmed against it on full sets; (4) an exact way for what is left: members outside a bucket's largest component meet
all others of the bucket, in blocks, by an inverted index over their shingles; (5) connected components. A group of m
near copies costs O(m) confirmations instead of m*m pairs, and no link that crosses components goes unconfirmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.graph import connected_components, joined_components
from tidemark.llm.storage import Scratch, texts, with_row_key

#: Nodes from here on stand for sets that no id names alone: none of their rows has one, or another set has the same one.
UNNAMED = 1 << 62


@dataclass(frozen=True)
class DedupConfig:
    """words: of a shingle; percent: least Jaccard similarity of a link; bands x rows: coordinates of the sketch. A pair
    at similarity s misses all buckets with probability (1 - s**rows)**bands: 3e-6 at 0.8. leader_rounds: of step 3.
    block, block_bytes: members in a block of step 4 and about their sets' bytes, unless one set is larger. broadcast_ids: ids sent to all executors at most (8 bytes each), beyond which
    the join is shuffled."""

    words: int = 2
    percent: int = 80
    bands: int = 32
    rows: int = 5
    leader_rounds: int = 3
    block: int = 512
    block_bytes: int = 32 << 20
    broadcast_ids: int = 500_000


def sketch_batch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketches of non-empty sets of distinct hashes, as an array (sets, t)."""
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 40) - 1)
    for i in range(2 * t):
        thrown = K.mix(elements ^ K.seed(i + 1))
        value = (thrown & low) | np.uint64(i << 40)
        if i < t:
            bins = ((thrown >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        else:
            bins = np.full(len(elements), i - t)
        np.minimum.at(out, owner * t + bins, value)
        left = (out.reshape(-1, t) == np.iinfo(np.uint64).max).any(axis=1)
        if not left.any():
            break
        keep = left[owner]
        elements, owner = elements[keep], owner[keep]
    return out.reshape(-1, t)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = sketch.reshape(len(sketch), bands, rows)
    x = np.broadcast_to(np.array([K.seed(1000 + b) for b in range(bands)], np.uint64), (len(sketch), bands)).copy()
    for k in range(rows):
        x = K.mix(x * K.MIX_1 + cells[:, :, k])
    return x.view(np.int64)


SKETCH_SCHEMA = "doc_id long, n long, f1 long, f2 long, bands array<long>"


def _sketches(config: DedupConfig, keys: tuple[str, ...] = ()):
    """The columns `keys` follow doc_id and text and are carried along."""
    t = config.bands * config.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, sets in K.shingle_sets(batch.column(1), config.words):
                sizes, f1, f2 = fingerprints(sets)
                full = np.flatnonzero(sizes)
                counts = np.where(sizes > 0, config.bands, 0)
                bands = np.empty(0, np.int64)
                if len(full):
                    bands = band_hashes(sketch_batch([sets[k] for k in full], t), config.bands, config.rows).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(bands))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)), pa.array(sizes), pa.array(f1), pa.array(f2), lists, *(batch.column(2 + k).slice(first, len(sets)) for k in range(len(keys)))],
                    ["doc_id", "n", "f1", "f2", "bands", *keys],
                )

    return run


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, two sums of hashes) of sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    sums = np.zeros((2, len(sets)), np.uint64)
    if len(full):
        elements = np.concatenate([sets[k] for k in full])
        cuts = np.concatenate(([0], np.cumsum(sizes[full])))[:-1]
        for k in (0, 1):
            sums[k, full] = np.add.reduceat(K.mix(elements ^ K.seed(7001 + k)), cuts)
    return sizes, sums[0].view(np.int64), sums[1].view(np.int64)


def _sets(config: DedupConfig):
    """(doc_id, what tells a set apart, the set as bytes of ascending 64-bit hashes) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in K.shingle_sets(batch.column(1), config.words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), *map(pa.array, fingerprints(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", *SET, "grams"])

    return run


def _confirm(percent: int):
    """(a, b, set of a, set of b) -> the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = np.zeros(len(left), bool)
            for k in range(len(left)):
                x, y = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    good[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return run


def _block_links(percent: int):
    """All links between the members of a block that ask (component differs) and all members, by an inverted index; of
    each asking member one link to each other component is enough."""

    def run(table: pa.Table) -> pa.Table:
        uid, comp = table["uid"].to_numpy(), table["comp"].to_numpy()
        asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["grams"].combine_chunks()]
        query = np.flatnonzero(asks)
        grams = np.concatenate([sets[q] for q in query])
        owner = np.repeat(np.arange(len(query)), [len(sets[q]) for q in query])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        sizes = np.array([len(sets[q]) for q in query])
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for d in range(len(uid)):
            at, to = np.searchsorted(grams, sets[d], "left"), np.searchsorted(grams, sets[d], "right")
            n = to - at
            hits = owner[np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            common = np.bincount(hits, minlength=len(query))
            for q in np.flatnonzero((100 * common >= percent * (sizes + len(sets[d]) - common)) & (comp[query] != comp[d])):
                found.setdefault((int(uid[query[q]]), int(comp[d])), (int(uid[query[q]]), int(uid[d])))
        pairs = list(found.values())
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`; of `docs` only doc_id and text are read.

    Null or empty texts, and texts without words: n_shingles 0, linked with nothing, so component_id = doc_id. Texts of
    fewer words than a shingle have their whole sequence as one. Rows without doc_id are linked as any others, but name
    no component: component_id is the smallest id that any row of the component has, null where none has, and kept is
    the null-safe doc_id = component_id. Rows that share a doc_id but not their shingles are documents of their own,
    repeated rows are alike. Empty table: an empty result. Texts may be of any length.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    judged = _judged(texts(docs), (), scratch, config)
    return judged.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: What tells shingle sets apart: their size and two sums of hashes.
SET = ["n", "f1", "f2"]


def _judged(docs: DataFrame, keys: tuple[str, ...], scratch: Scratch, config: DedupConfig) -> DataFrame:
    """(doc_id, keys, n, node, component_id) of (doc_id, text, keys): node stands for the row's component, null without
    words; component_id is the smallest id in it, and the row's own without words."""
    carried = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in keys)
    sketched = scratch.save(docs.mapInArrow(_sketches(config, keys), SKETCH_SCHEMA + carried))
    unnamed = F.lit(UNNAMED) + F.xxhash64(*SET).bitwiseAND(F.lit(UNNAMED - 1))
    groups = scratch.save(sketched.where("n > 0").groupBy(*SET).agg(F.min("doc_id").alias("least")))
    #: An id that several sets have as their smallest names none of them.
    twice = groups.where("least is not null").groupBy("least").agg(F.count("*").alias("sets")).where("sets > 1").select(F.col("least").alias("twice"))
    shared_ids = not twice.isEmpty()
    named = F.coalesce("least", unnamed)
    if shared_ids:
        groups = groups.join(twice, F.col("least") == F.col("twice"), "left")
        named = F.when(F.col("twice").isNotNull(), unnamed).otherwise(named)
    groups = groups.select(*SET, "least", named.alias("uid"))
    groups = scratch.save(groups) if shared_ids else groups
    #: One row of each set speaks for its copies, which have the same bands.
    own = sketched.where("n > 0").join(groups, SET).where(F.col("doc_id").eqNullSafe(F.col("least"))).select("uid", "n", "bands")
    member = own.select("uid", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low < high").select("bucket")
    members = scratch.save(member.join(shared, "bucket").groupBy("bucket", "uid").agg(F.max("n").alias("n")))
    if members.isEmpty():
        component = groups.select(F.col("uid").alias("node"), F.col("uid").alias("component")).limit(0)
    else:
        component = _link(docs.select("doc_id", "text"), groups, members, scratch, config)
    labelled = groups.join(component, F.col("uid") == F.col("node"), "left").select(*SET, "least", F.coalesce("component", "uid").alias("node"))
    if shared_ids:
        labelled = scratch.save(labelled)
        ids = scratch.save(labelled.groupBy("node").agg(F.min("least").alias("component_id")))
        labelled = labelled.join(ids, "node")
    else:
        labelled = labelled.withColumn("component_id", F.when(F.col("node") < UNNAMED, F.col("node")))
    found = sketched.drop("bands").join(labelled.select(*SET, "node", "component_id"), SET, "left")
    return found.select("doc_id", *keys, "n", "node", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _link(docs: DataFrame, groups: DataFrame, members: DataFrame, scratch: Scratch, config: DedupConfig) -> DataFrame:
    """(node, component) of the uids in buckets that several sets share."""
    wanted = scratch.save(members.select("uid").distinct().join(groups, "uid").select("uid", "least", *SET))
    n_wanted, unnamed = wanted.agg(F.count("*"), F.count_if(F.col("uid") >= UNNAMED)).first()
    few = n_wanted <= config.broadcast_ids
    ids = wanted.select(F.col("least").alias("id")).distinct()
    own = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    read = own.mapInArrow(_sets(config), "doc_id long, n long, f1 long, f2 long, grams binary").where("n > 0")
    sets = None if unnamed else scratch.save(read.select(F.col("doc_id").alias("uid"), "grams"))
    if sets is None or sets.count() != n_wanted:
        #: Some id has several rows: of copies, or of texts that other ids stand for. What they hold tells them apart.
        once = read.groupBy(*SET).agg(F.first("grams").alias("grams"))
        sets = scratch.save(once.join(F.broadcast(wanted) if few else wanted, SET).select("uid", "grams"))
    component = None
    for i in range(config.leader_rounds):
        at = _with_component(members, component)
        order = F.col("uid") if i == 0 else F.xxhash64("uid", F.lit(i))
        leaders = at.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "uid", "comp")).alias("l")).select("bucket", F.col("l.uid").alias("leader"), F.col("l.comp").alias("lead_comp"))
        pairs = at.join(leaders, "bucket").where("comp <> lead_comp").select(F.col("uid").alias("a"), F.col("leader").alias("b")).distinct()
        new = scratch.save(_confirmed(pairs, sets, config))
        if i and new.isEmpty():
            break
        component = scratch.save(connected_components(new, scratch)) if component is None else joined_components(component, new, scratch)
    rest = _rest(members, component, sets, config)
    if rest is not None:
        extra = scratch.save(rest.distinct())
        if not extra.isEmpty():
            component = joined_components(component, extra, scratch)
    return component


def _with_component(members: DataFrame, component: DataFrame | None) -> DataFrame:
    if component is None:
        return members.withColumn("comp", F.col("uid"))
    return members.join(component, F.col("uid") == F.col("node"), "left").select("bucket", "uid", "n", F.coalesce("component", "uid").alias("comp"))


def _confirmed(pairs: DataFrame, sets: DataFrame, config: DedupConfig) -> DataFrame:
    left = sets.select(F.col("uid").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("uid").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(_confirm(config.percent), "a long, b long")


def _rest(members: DataFrame, component: DataFrame, sets: DataFrame, config: DedupConfig) -> DataFrame | None:
    """The links across components that no leader round has met. Buckets of two are done: one of them was the leader."""
    at = _with_component(members, component)
    sizes = at.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    split = sizes.groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.sum("grams").alias("grams"), F.count("*").alias("comps")).where("comps > 1 and m > 2")
    split = split.select("bucket", F.col("m").alias("bucket_size"), (8 * F.col("grams")).alias("bucket_bytes"), F.col("top.comp").alias("top"))
    open_ = at.join(split, "bucket").select("bucket", "uid", "comp", "bucket_size", "bucket_bytes", (F.col("comp") != F.col("top")).alias("asks"))
    small = open_.where(F.col("bucket_size") <= 8)
    pairs = (
        small.where("asks").select("bucket", F.col("uid").alias("a"), F.col("comp").alias("comp_a"))
        .join(small.select("bucket", F.col("uid").alias("b"), F.col("comp").alias("comp_b")), "bucket")
        .where("comp_a <> comp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    links = _confirmed(pairs, sets, config)
    large = open_.where(F.col("bucket_size") > 8)
    if large.isEmpty():
        return links
    blocks = F.least("bucket_size", F.greatest(F.ceil(F.col("bucket_size") / config.block), F.ceil(F.col("bucket_bytes") / config.block_bytes))).cast("int")
    dealt = large.withColumn("mine", F.pmod(F.xxhash64("uid"), blocks).cast("int")).withColumn("blocks", blocks)
    askers = dealt.where("asks").select("bucket", "uid", "comp", "asks", F.col("mine").alias("asking"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("asked"))
    busy = askers.select("bucket", "asking").distinct()
    others = dealt.join(busy, "bucket").select("bucket", "uid", "comp", F.lit(False).alias("asks"), "asking", F.col("mine").alias("asked"))
    both = askers.union(others).join(sets, "uid").select("bucket", "asking", "asked", "uid", "comp", "asks", "grams")
    return links.union(both.groupBy("bucket", "asking", "asked").applyInArrow(_block_links(config.percent), "a long, b long"))


def drop_near_duplicates(docs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """`docs`, with all columns, whatever their names, with one row of each group of near copies: that with the smallest
    id, of equal ids, or if no row has one, the first one by file and place in it.

    Rows are told apart by their place in the files of `docs` (rows from elsewhere are written first), so rows with null or
    repeated ids are linked and dropped by themselves: repeated rows leave one, rows that share an id but not their texts
    all stay. Null and empty texts and texts without words are linked with nothing and stay. Empty table: an empty result.
    """
    scratch = Scratch(docs.sparkSession, "minhash-drop")
    keyed, (file, place) = with_row_key(docs)
    read = texts(keyed, file, place)
    steps = Scratch(docs.sparkSession, "minhash-steps")
    judged = scratch.save(_judged(read, (file, place), steps, config).where("n > 0"))
    steps.clear()
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(file).alias("file"), F.col(place).alias("place"))
    first = judged.groupBy("node").agg(F.min(row).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    first = scratch.save(first.select("node", F.col("first.file").alias("first_file"), F.col("first.place").alias("first_place")))
    stays = (F.col(file) == F.col("first_file")) & (F.col(place) == F.col("first_place"))
    gone = scratch.save(judged.join(first, "node").where(~stays).select(F.col(file).alias("gone_file"), F.col(place).alias("gone_place")))
    scratch.drop(judged, first)
    few = gone.count() <= config.broadcast_ids // 4  # a file's name beside each
    same = (F.col(file) == F.col("gone_file")) & (F.col(place) == F.col("gone_place"))
    return keyed.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*docs.columns)
