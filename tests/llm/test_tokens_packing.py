import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, tokens

PARTS = ["a", "S", "re", "'", "'s", "'ll", "'ve", " ", "  ", "\n", "\t", "é", "12", "½", ".", "!!", "<|endoftext|>", "ß", "中文", " ", " ", "😀", "\0", "\x1c", "\x85", "Don't", "'sup"]
TEXTS = [(1, "Hello world, it's 5 o'clock!"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "word " * 5000), (5, "é" * 3000)]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_tokenizers_ids(reference):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = [list(x) for _, xs in tokens.encoded(pa.array(texts), tokens.vocabulary()) for x in xs]
    assert got == [reference(t) for t in texts]


def test_memo_that_starts_anew_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    fresh = tokens.Encoder(tokens.vocabulary())
    for text in ("one two three four", "five six one two", "seven eight one"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert list(fresh.encode(raw, np.array([0, len(raw)]))[0]) == reference(text)


@pytest.mark.parametrize("n, expected", [(1, [1]), (2048, [2048]), (2049, [2048, 1]), (4096 + 7, [2048, 2048, 4, 2, 1])])
def test_binary_lengths(n, expected):
    assert packing.binary_lengths(n) == expected


def test_packing_is_an_exact_round_trip(documents, reference):
    rows = packing.pack(documents(*TEXTS, extra=True)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and 1 << r.bucket == r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, t in set(TEXTS) - {(3, "")}:
        own = [*reference(t), 1]
        pieces = sorted((r.start, r.ids) for r in by[i, len(own)])
        assert [x for _, ids in pieces for x in ids] == own
    assert len(by[3, 1]) == 2
    assert packing.pack(documents()).count() == 0


def test_buckets_are_written(documents, tmp_path):
    packing.write_buckets(packing.pack(documents((1, "a b c d"))), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("bucket=*")) == ["bucket=0", "bucket=2"]


@pytest.mark.parametrize("block", [3, 64, 1 << 19])
def test_counts_over_blocks(documents, reference, block):
    found = token_counts.document_token_counts(documents(*TEXTS, extra=True), block_tokens=block).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in found) == sorted((i is None, i or 0, len(reference(t))) for i, t in TEXTS)
    by_file = {}
    for r in found:
        by_file.setdefault(r.file, []).append((r.ordinal, r.start, r.n_tokens))
    for rows in by_file.values():
        at = 0
        for k, (ordinal, start, n) in enumerate(sorted(rows)):
            assert (ordinal, start) == (k, at)
            at += n + 1


def test_foreign_blocks(spark):
    stream = np.array([5, 9, 9, 1, 2, 3, 9, 4], "<u4")
    parts = [(1, 0, bytearray(stream[:3].tobytes())), (1, 2, bytearray(stream[3:].tobytes())), (1, 1, None), (2, 0, bytearray())]
    blocks = spark.createDataFrame(parts, "file long, block long, payload binary")
    got = sorted((r.ordinal, r.start, r.n_tokens) for r in token_counts.separator_scan(blocks, end_id=9, width=4).collect())
    assert got == [(0, 0, 1), (1, 2, 0), (2, 3, 3)]
    assert token_counts.separator_scan(blocks.limit(0), 9, 4).count() == 0


def test_other_vocabularies_are_left_to_the_library(tmp_path):
    import json

    made = json.loads(open(tokens.vocabulary(), encoding="utf-8").read())
    made["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "lower.json")
    (tmp_path / "lower.json").write_text(json.dumps(made))
    texts = ["Hello World", "", "ÀB don't", "x"]
    own = Tokenizer.from_file(path)
    assert not tokens.Encoder(path).by_pieces and tokens.Encoder(tokens.vocabulary()).by_pieces
    assert [list(x) for _, xs in tokens.encoded(pa.array(texts), path) for x in xs] == [own.encode(t, add_special_tokens=False).ids for t in texts]
