import collections
import itertools
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bm25_search, resharding
from tidemark.llm.storage import with_row_key

WORDS = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def cost(flow, costs):
    return sum(f * c for row, cs in zip(flow, costs, strict=True) for f, c in zip(row, cs, strict=True))


def best_cost(sizes, capacities, costs):
    """By trying all ways to send unit after unit."""
    units = [i for i, s in enumerate(sizes) for _ in range(s)]
    return min(sum(costs[i][j] for i, j in zip(units, to, strict=True)) for to in itertools.product(range(len(capacities)), repeat=len(units)) if all(to.count(j) <= c for j, c in enumerate(capacities)))


def test_flow_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(0, 3) for _ in range(2)]
        capacities = [rng.randint(0, 3) for _ in range(3)]
        costs = [[rng.randint(0, 5) for _ in range(3)] for _ in range(2)]
        if sum(sizes) > sum(capacities):
            with pytest.raises(ValueError):
                resharding.min_cost_flow(sizes, capacities, costs)
            continue
        flow = resharding.min_cost_flow(sizes, capacities, costs)
        assert [sum(r) for r in flow] == sizes and all(sum(c) <= k for c, k in zip(zip(*flow, strict=True), capacities, strict=True))
        assert cost(flow, costs) == best_cost(sizes, capacities, costs)


def test_fewest_bytes_move():
    flow = resharding.min_cost_flow([900, 50, 50], [250, 250, 250, 250], [[0 if i == j else 1 for j in range(4)] for i in range(3)])
    assert [flow[i][i] for i in range(3)] == [250, 50, 50]


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_shards_are_even_and_slots_gapless(documents, block_bytes):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 60)) for k in range(900)] + [(None, None), (None, None), (3, ""), (3, ""), (4, "é")]
    got = resharding.reshard(documents(*rows, extra=True), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), resharding.ReshardConfig(shards=7, block_bytes=block_bytes)).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len((t or "").encode()) + 8) for i, t in rows)
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(sums.values()) - min(sums.values()) <= 68
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sum(r.shard == r.old_shard for r in got) >= 300
    assert resharding.reshard(documents(), F.lit(0)).count() == 0


BIG = (1 << 53) + 1
ODD = [(None, "a"), (None, "a"), (None, None), (BIG, "x" * 30), (BIG + 2, "x" * 30), (BIG, "y"), (7, "z"), (7, "z"), (8, ""), (9, "é" * 40)]


def in_files(documents, tmp_path, rows, extra=True):
    documents(*rows, extra=extra).repartition(3).write.parquet(str(tmp_path / "in"))
    return documents().sparkSession.read.parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_rewriting_keeps_every_row(documents, spark, tmp_path, block_bytes):
    rows = ODD + [(BIG + 10 + 2 * k, "x" * (k % 40)) for k in range(200)]
    docs, key = with_row_key(in_files(documents, tmp_path, rows))
    assert key == ["row_file", "row_place"]
    old = F.coalesce(F.col("doc_id") % 3, F.lit(0))
    plan = resharding.plan(docs, old, resharding.ReshardConfig(shards=4, block_bytes=block_bytes), key=key)
    assert collections.Counter(r.doc_id for r in plan.rows.collect()) == collections.Counter(i for i, _ in rows)
    touched = resharding.rewrite(docs, plan, str(tmp_path / "out"))
    assert touched == [0, 1, 2, 3]
    files = spark.read.parquet(str(tmp_path / "out"))
    assert set(files.columns) == {*docs.columns, "_shard", "_slot"} - set(key)
    got = [(r._shard, r._slot, r.doc_id, r.text) for r in files.collect()]
    assert collections.Counter(g[2:] for g in got) == collections.Counter(rows)
    assert sorted(g[:2] for g in got) == sorted((r.shard, r.slot) for r in plan.rows.collect())
    digest = collections.Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in plan.rows.collect())
    assert digest == collections.Counter((i, zlib.crc32((t or "").encode()), s, k) for s, k, i, t in got)
    for shard in touched:
        order = [r._slot for r in files.where(F.col("_shard") == shard).collect()]
        assert order == sorted(order)


def test_only_affected_shards_are_written(documents, spark, tmp_path):
    docs, key = with_row_key(in_files(documents, tmp_path, [(k, "x" * 20) for k in range(100)]))
    old = F.when(F.col("doc_id") < 50, 0).when(F.col("doc_id") < 70, 1).otherwise(2)
    plan = resharding.plan(docs, old, resharding.ReshardConfig(shards=3), key=key)
    docs.select("*", old.alias("old")).write.partitionBy("old").parquet(str(tmp_path / "layout"))
    before = {p: p.read_bytes() for p in (tmp_path / "layout").rglob("*.parquet")}
    touched = resharding.rewrite(docs, plan, str(tmp_path / "out"))
    assert 0 in touched and 1 in touched and before == {p: p.read_bytes() for p in before}
    even = docs.where("doc_id % 10 < 3 AND doc_id < 90")
    same = resharding.plan(even, F.col("doc_id") % 10, resharding.ReshardConfig(shards=3), key=key)
    assert resharding.rewrite(even, same, str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        resharding.plan(docs.withColumn("row_place", F.lit(1)), old, key=key)


def test_digest_of_the_rewritten_shards(documents, tmp_path):
    rows = ODD + [(k, "x" * (k % 50)) for k in range(300)]
    docs = in_files(documents, tmp_path, rows)
    got = resharding.resharded(docs, F.col("doc_id") % 5, resharding.ReshardConfig(shards=6)).collect()
    digest = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, *digest(t)) for i, t in rows)
    for shard in range(6):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    sums = collections.Counter()
    for r in got:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) <= 100
    empty = documents()
    empty.write.parquet(str(tmp_path / "empty"))
    assert resharding.resharded(empty.sparkSession.read.parquet(str(tmp_path / "empty")), F.lit(0)).count() == 0


def tokens(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, config):
    docs = [(i, collections.Counter(tokens(t))) for i, t in docs if i is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = collections.Counter(w for _, c in docs for w in c)
    out = {}
    for q, words in queries.items():
        terms = sorted((w for w in words if df[w]), key=lambda w: -words[w] * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)))
        assert len(terms) <= config.query_terms
        scores = []
        for i, c in docs:
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (config.k1 + 1) / (c[w] + config.k1 * (1 - config.b + config.b * sum(c.values()) / mean)) for w in terms if c[w])
            if s > 0:
                scores.append((round(-s, 9), i))
        out[q] = sorted(scores)[: config.k]
    return out


@pytest.mark.parametrize("shard_docs, query_block", [(8, 3), (1000, 50_000)])
def test_search_against_brute_force(spark, documents, shard_docs, query_block):
    rng = random.Random(2)
    vocabulary = [f"v{k}" for k in range(60)] + ["Été", "ÉTÉ"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(k, text(rng.randint(1, 40))) for k in range(300)] + [(400, None), (401, ""), (None, "v1 v2"), (5, "v1 v1"), (6, "v1 v1")]
    asked = [(k, text(6)) for k in range(25)] + [(30, "unknown"), (31, None), (None, "v1"), (32, "v7"), (32, "v9")]
    queries = collections.defaultdict(collections.Counter)
    for q, t in asked:
        if q is not None and t is not None:
            queries[q].update(tokens(t))
    config = bm25_search.SearchConfig(k=5, shard_docs=shard_docs, query_block=query_block, block=4)
    got = collections.defaultdict(list)
    for r in bm25_search.search(documents(*docs, extra=True), spark.createDataFrame(asked, "query_id long, text string"), config).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(-r.score, 9), r.doc_id))
    want = {q: h for q, h in brute(docs, queries, config).items() if h}
    assert dict(got) == want
    assert bm25_search.search(documents(), spark.createDataFrame(asked, "query_id long, text string")).count() == 0
    assert bm25_search.search(documents(*docs), spark.createDataFrame([], "query_id long, text string")).count() == 0


@pytest.mark.parametrize("shard_docs, query_words", [(16, 500), (1000, 200_000)])
def test_queries_of_hundreds_of_terms(spark, documents, shard_docs, query_words):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(900)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(100, 500)))) for k in range(120)]
    asked = [(k, " ".join(rng.sample(vocabulary, n))) for k, n in enumerate((3, 30, 40, 200, 400, 700))] + [(90, docs[0][1]), (91, docs[7][1])]
    queries = {q: collections.Counter(tokens(t)) for q, t in asked}
    config = bm25_search.SearchConfig(shard_docs=shard_docs, query_words=query_words, shard_group=2)
    got = collections.defaultdict(list)
    for r in bm25_search.search(documents(*docs), spark.createDataFrame(asked, "query_id long, text string"), config).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(-r.score, 9), r.doc_id))
    assert dict(got) == brute(docs, queries, config)
    assert got[90][0][1] == 0 and got[91][0][1] == 7


def test_exact_scores_come_from_the_documents_own_postings(monkeypatch):
    """Scores of chosen documents against sums over all terms, without a matrix of documents by the query's terms."""
    monkeypatch.setattr(bm25_search.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"v{k}" for k in range(300)], k=rng.randint(0, 60))) for _ in range(80)]
    config = bm25_search.SearchConfig()
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    shard = bm25_search.Shard(next(bm25_search._build(config)(iter([batch]))), 30.0, config)
    at = np.array(rng.sample(range(len(shard.terms)), 200))
    idfs = np.array([rng.random() for _ in at])
    want = np.zeros(80)
    for term, idf in sorted(zip(at.tolist(), idfs.tolist(), strict=True)):
        own = slice(shard.starts[term], shard.starts[term + 1])
        want[shard.docs[own]] += shard.adds[own] * idf
    monkeypatch.setattr(np, "tile", lambda *a: pytest.fail("documents by terms"))
    assert shard.exact(at, idfs, np.arange(80)).tolist() == want.tolist()


def test_a_shard_is_unfolded_once_for_many_blocks(monkeypatch):
    """Rows of one shard and several blocks of queries in a task; the k best are those of all shards."""
    monkeypatch.setattr(bm25_search.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"v{k}" for k in range(300)], k=rng.randint(1, 60))) for _ in range(120)]
    config = bm25_search.SearchConfig(k=3, shard_docs=40)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 20), pa.int64()), pa.array(texts[k : k + 20])], ["doc_id", "text"]) for k in range(0, 120, 20)]
    index = list(bm25_search._build(config)(iter(batches)))
    read = lambda own, c, t: np.frombuffer(own[c][0].as_buffer(), t)
    vocabulary = sorted(read(index[0], "terms", np.int64).tolist())
    idf = {t: 1.0 + k % 7 for k, t in enumerate(vocabulary)}
    asked = {q: rng.sample(vocabulary, 25 if q % 2 else 5) for q in range(8)}
    packs = []
    for part in range(4):
        rows = [(q, t, idf[t], 0.0, part) for q in (2 * part, 2 * part + 1) for t in asked[q]]
        packs.append(bm25_search._pack(pa.table(dict(zip(("query_id", "term", "idf", "floor", "part"), zip(*rows, strict=True), strict=True)))).to_batches()[0])
    rows, sums = [], {q: collections.defaultdict(float) for q in asked}
    for own in index:
        rows += [pa.RecordBatch.from_arrays([*own.columns, *pack.columns], [*own.schema.names, *pack.schema.names]) for pack in packs]
        terms, starts, docs, tfs, ids, lengths = (read(own, c, t) for c, t in (("terms", np.int64), ("starts", np.int32), ("docs", np.uint16), ("tfs", np.uint8), ("doc_ids", np.int64), ("lengths", np.int32)))
        lists = {t: range(starts[k], starts[k + 1]) for k, t in enumerate(terms.tolist())}
        for q, own_terms in asked.items():
            for t in own_terms:
                for p in lists.get(t, ()):
                    sums[q][int(ids[docs[p]])] += idf[t] * int(tfs[p]) * (config.k1 + 1) / (int(tfs[p]) + config.k1 * (1 - config.b + config.b * int(lengths[docs[p]]) / 30.0))
    built, shard = [], bm25_search.Shard
    monkeypatch.setattr(bm25_search, "Shard", lambda row, *a: built.append(row["shard"][0].as_py()) or shard(row, *a))
    got = collections.defaultdict(list)
    for batch in bm25_search._search(30.0, config)(iter(rows)):
        for r in batch.to_pylist():
            got[r["query_id"]].append((round(-r["score"], 9), r["doc_id"]))
    assert built == [own["shard"][0].as_py() for own in index] and len(index) == 3
    assert got == {q: sorted((round(-s, 9), d) for d, s in own.items())[:3] for q, own in sums.items()}


def test_a_small_tail_joins_the_shard_before_it(monkeypatch):
    monkeypatch.setattr(bm25_search.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    config = bm25_search.SearchConfig(shard_docs=40)
    for n, want in ((40, [40]), (45, [45]), (60, [40, 20]), (85, [40, 45]), (3, [3])):
        batches = [pa.RecordBatch.from_arrays([pa.array(range(k, min(k + 5, n)), pa.int64()), pa.array([f"a{i} b" for i in range(k, min(k + 5, n))])], ["doc_id", "text"]) for k in range(0, n, 5)]
        index = list(bm25_search._build(config)(iter(batches)))
        assert [own["n_docs"][0].as_py() for own in index] == want and len({own["shard"][0].as_py() for own in index}) == len(want)
        assert np.concatenate([np.frombuffer(own["doc_ids"][0].as_buffer(), np.int64) for own in index]).tolist() == list(range(n))
