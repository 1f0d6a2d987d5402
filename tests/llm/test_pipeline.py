"""The pipeline's stages, each against what it must do to its own input."""

import glob
import os

import corpus_pipeline
import duckdb
import pytest

from tidemark.llm import packing, queries, tokens
from tidemark.llm.storage import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = scratch.save(stage(spark, docs, SF))
        out.append((name, docs, new))
        docs = new
    return out


def test_stage_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
    assert all(new.columns == old.columns for _, old, new in stages[:-1])


def test_stages_only_drop(stages):
    for _, old, new in stages[:-1]:
        assert {r.doc_id for r in new.select("doc_id").collect()} <= {r.doc_id for r in old.select("doc_id").collect()}
    assert stages[3][1].count() == stages[3][2].count()


def test_near_copies_by_all_pairs(stages):
    from test_dedup_decontaminate import brute

    rows = [(r.doc_id, r.text) for r in stages[1][1].select("doc_id", "text").collect()]
    assert {r.doc_id for r in stages[1][2].select("doc_id").collect()} == {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}


def test_no_item_is_left(stages, spark):
    import re

    words = lambda t: " ".join(re.findall(r"[a-z0-9\u0080-￿]+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r.doc_id for r in stages[2][2].collect() if any(i in words(r.text) for i in items)]


def test_packing_is_whole(stages):
    kept = {r.doc_id: r.text for r in stages[3][2].collect()}
    ids = {}
    for r in stages[4][2].orderBy("doc_id", "start").collect():
        ids.setdefault(r.doc_id, []).extend(r.ids)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    assert ids == {i: [*t.encode(x, add_special_tokens=False).ids, packing.END_ID] for i, x in kept.items()}


def test_run_gives_the_last_stage(stages, spark):
    got = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in got.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in stages[4][2].collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    ours = queries.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in ours.select(*columns).collect()))) == sorted(map(repr, theirs))


def test_stages_take_odd_rows(spark, documents):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, None), (1, None), (2, ""), (None, "clean words of a row without an id"), (None, "other words of such a row, no copy"), (None, None), (3, f"before it {item} and after"), (3, "of the same id and clean, quite short")]
    rows += [(4, "the token=abcdefgh12 is here and words go on"), (4, "the token=abcdefgh12 is here and words go on"), (5, "long words of many kinds " * 40_000), (6, "  \n ")]
    docs = documents(*rows, extra=True)
    text = lambda r: (r.doc_id or 0, (r.text or "")[:20])
    everything = sorted((i or 0, (t or "")[:20]) for i, t in rows)
    want = {"toxicity": everything, "minhash_near_dedup": sorted(set(everything) | {(1, ""), (0, "")}), "benchmark_decontamination": [x for x in everything if x != (3, "before it " + item[:10])]}
    want["minhash_near_dedup"] = sorted([*want["minhash_near_dedup"], (1, "")])  # both rows of id 1 have no words
    want["secret_scans"] = sorted((i, "the [secret] is here" if i == 4 else t) for i, t in everything)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted(map(text, out.collect())) == want[name], name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == len(rows)


def test_stages_take_an_empty_table(spark, documents):
    docs = documents(extra=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
        docs = out if name != "packing" else docs
