import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import periodic_runs, pieces, whitening

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def runs_by_hand(words, least=6, exponent=4):
    """Every stretch of every period that can't be extended, at its smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > start and end - start + q >= max(least, exponent * q):
                found.setdefault((start, end - start + q), q)
            start = max(end, start) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("size", [3, 60, 1 << 20])
@pytest.mark.parametrize("exponent", [2, 4])
def test_runs_of_random_rows(monkeypatch, size, exponent):
    monkeypatch.setattr(periodic_runs, "GRID", size)
    rng = random.Random(size + exponent)
    for _ in range(120):
        rows = []
        for _ in range(rng.randint(0, 5)):
            words = [rng.randint(0, rng.choice((1, 3))) for _ in range(rng.randint(0, 50))]
            if rng.random() < 0.5:
                words += ([rng.randint(0, 5) for _ in range(rng.randint(1, 9))] * 12)[: rng.randint(0, 80)] + words[:5]
            rows.append(words)
        flat, sizes = np.array([w for words in rows for w in words], np.int64), np.array([len(words) for words in rows], np.int64)
        got = [tuple(map(int, r)) for r in zip(*periodic_runs.find_runs(flat, sizes, 6, exponent), strict=True)]
        assert got == [(k, *r) for k, words in enumerate(rows) for r in runs_by_hand(words, 6, exponent)]


def expected_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = None if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_digests(documents):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("ab cd é f g".split(" ")) for _ in range(rng.randint(0, 90)))) for k in range(150)]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 5
    rows += [(900, None), (901, ""), (902, " \t\n "), (None, "x " * 9), (903, "la " * 8), (903, "la " * 8), (904, "A a A a\x0bA\x0ca A a  A"), (905, "long tail " * 3000), (-7, "　 　 　 　 　 　")]
    docs = documents(*rows, extra=True)
    got = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.tailed(docs))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, got), key=key) == sorted((expected_runs(i, t) for i, t in rows), key=key)
    assert periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.tailed(documents()))).count() == 0


def test_runs_and_collapsed_texts(documents):
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(documents((1, "so so so so so so it goes"), (2, "a b a b a b"), (3, None)), least=6, exponent=3).collect()}
    assert [(r.start, r.length, r.period) for r in rows[1].runs] == [(0, 6, 1)] and rows[1].collapsed == "so it goes" and rows[1].n_words == 8
    assert [(r.start, r.length, r.period) for r in rows[2].runs] == [(0, 6, 2)] and rows[2].collapsed == "a b"
    assert rows[3].runs == [] and rows[3].collapsed == ""
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.periodic_runs(documents(), exponent=1)


# Pieces

PARTS = ["a", "S", "re", "'", " ", "  ", "\n", "\t", "é", "12", "½", ".", "!!", "<s>", "</s>", "<0x0A>", "ß", "中文", "▁", " ", "😀", "\0", "the", " hello", "ing", "aaaa", "    ", "ll", "　", "abab"]


@pytest.fixture(scope="module")
def library():
    return pieces.encoder(pieces.model_file()).library


def ids_of(encoder, texts):
    return [list(map(int, ids[c[k] : c[k + 1]])) for f, n, data, offsets in pieces.K.slices(pa.array(texts)) for ids, c in [encoder.encode(data, offsets)] for k in range(n - f)]


def test_pieces_give_the_library_ids(library):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["a" * 5000, " " * 3001, "ab " * 3000, "\U0010ffff" * 50, ""]
    own = pieces.encoder(pieces.model_file())
    assert own.by_table and ids_of(own, texts) == library.encode(texts)


def test_bounded_memos_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 2)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    fresh = pieces.Encoder(pieces.model_file())
    for text in ("one two three four", "five six one two", "seven eight one"):
        assert ids_of(fresh, [text]) == [library.encode(text)]


def test_other_models_are_left_to_the_library(tmp_path):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_file(), "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "other.model")
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    own, texts = pieces.Encoder(path), ["  two  blanks ", "", "x"]
    assert not own.by_table and ids_of(own, texts) == SentencePieceProcessor(model_file=path).encode(texts)


def test_any_ids_are_decoded_as_the_library_does(library):
    rng, own = random.Random(6), pieces.encoder(pieces.model_file())
    pool = [0, 1, 2, 259, 259, 28705, 28705, *range(3, 259, 9), *range(260, 32000, 1500)]
    rows = [[rng.choice(pool) for _ in range(rng.randint(0, 7))] for _ in range(3000)] + [library.encode("".join(rng.choice(PARTS) for _ in range(9))) for _ in range(500)]
    cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got = pieces.decoded(own, np.array([i for r in rows for i in r], np.int32), cuts)
    assert [t.decode() for t in got] == [library.decode(r) for r in rows]


def test_piece_digests(documents, library):
    rows = [(1, "Hello  wörld\n"), (2, None), (3, ""), (3, ""), (None, " x"), (4, "word " * 5000), (5, "é" * 3000), (6, "▁ a▁b")]
    got = pieces.digests(documents(*rows, extra=True)).collect()
    expected = [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in rows for ids in [library.encode(t or "")]]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(documents(*rows))).collect()}
    assert back[1] == "Hello  wörld\n" and back[2] == "" and back[4] == "word " * 5000
    assert pieces.digests(documents()).count() == 0
    odd = documents().sparkSession.createDataFrame([(1, [22557, None]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [(r.doc_id, r.text) for r in pieces.decode(odd).orderBy("doc_id").collect()] == [(1, "Hello"), (2, ""), (3, "")]


# Whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, component string"


def held(spark, rows, k=4, **more):
    return whitening.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], VECTORS), k, **more).collect()


def against_numpy(got, rows, k):
    x = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            x.setdefault(i, []).append(np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64))
    distinct = np.unique([v for vs in x.values() for v in vs], axis=0)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-9 * values[0]).sum()))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, c + 1) for i, vs in x.items() for _ in vs for c in range(k))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        c, options = r.component - 1, x[r.vec_id]
        z = [float((v - sums / n) @ vectors[:, c] / np.sqrt(values[c])) for v in options]
        s = sign.setdefault(c, 1 if np.isclose(z[0], r.whitened, rtol=1e-6) else -1)
        assert min(abs(s * a - r.whitened) for a in z) < 1e-9
        assert r.deviation in {int(((n * v - sums) ** 2).sum()) for v in options} and r.n == n
        assert abs(r.explained - values[c] / values.sum()) < 1e-12 and r.identity_error < 1e-9


def test_whitening_of_flat_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v) for k, v in enumerate(rng.standard_normal((300, 40)).tolist())]
    rows += [(5, rows[5][1])] * 200 + [(1000, rows[7][1]), (None, rows[9][1]), (1001, None), (1002, []), (1003, [float("nan")] * 40), (1004, [float("inf")] + [0.0] * 39), (1005, [None] + [0.0] * 39), (1006, [1.0, 2.0])]
    against_numpy(held(spark, rows), [r for r in rows if r[1] is None or len(r[1]) != 2], 4)


def test_fewer_components_and_none(spark):
    plane = [(k, [float(k), float(k * k % 7), 3.0]) for k in range(20)]
    against_numpy(held(spark, plane), plane, 4)
    assert held(spark, []) == [] and held(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and held(spark, [(1, None)]) == []


def test_deviations_beyond_a_long_are_null(spark):
    got = held(spark, [(1, [3e7, 0.0]), (2, [-3e7, 1.0]), (3, [1.0, 1.0])], 1)
    assert {r.vec_id: r.deviation is None for r in got} == {1: True, 2: True, 3: False} and abs(got[0].whitened) > 1


class Given:
    """Passes over a covariance that is known."""

    def __init__(self, values, seed=1):
        self.width, self.done = len(values), 0
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
        self.matrix = (turn * np.array(values)) @ turn.T

    def covariance_times(self, block):
        self.done += 1
        image = self.matrix @ block
        return image, block.T @ image, float(np.trace(self.matrix))


@pytest.mark.parametrize("values", [np.linspace(2, 1, 400), [9, 9, 9, 9, 5, *np.linspace(4, 1, 300)], [3, 2, 1e-3, *[0] * 200], 0.8 ** np.arange(150)])
def test_a_subspace_smaller_than_the_space(values):
    given = Given(values)
    found, got, gram, trace = whitening.leading(given, 4, block=8, subspace=48)
    keep = min(4, int((np.array(values) > 1e-9).sum()))
    assert np.allclose(got, np.sort(values)[::-1][:keep], rtol=1e-10) and np.isclose(trace, np.sum(values))
    assert np.abs(given.matrix @ found - found * got).max() < 1e-11 * got[0] and np.allclose(found.T @ found, np.eye(keep), atol=1e-12)
    assert given.done < 150
