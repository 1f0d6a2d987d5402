import math
import re
import zlib

import numpy as np
import pytest
import zstandard

from tidemark.llm import language_id, toxicity
from tidemark.llm.storage import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.fit(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels"))


def test_held_out_toxicity(spark, toxic_model):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    known = table(spark, "/root/testdata/sf0.1", "labels").join(docs.select("doc_id", "lang"), "doc_id")
    rows = toxicity.toxicity(docs, toxic_model).join(known, "doc_id").where("held_out").toPandas()
    assert rows[rows.toxic == 0].predicted.mean() < 0.02
    assert rows[rows.toxic == 1].predicted.mean() > 0.6
    assert rows[(rows.toxic == 1) & (rows.lang == "en")].predicted.mean() > 0.8
    assert rows[(rows.toxic == 1) & (rows.lang == "fr")].predicted.mean() > 0.5
    assert rows[(rows.toxic == 1) & (rows.lang == "de")].predicted.mean() > 0.2  # of Spanish ones, 12, none is found yet
    for lang in ("en", "fr", "de", "es"):
        assert rows[(rows.toxic == 0) & (rows.lang == lang)].predicted.mean() < 0.02
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in rows.doc_id)


def score_by_hand(text, model):
    """A text's score from the model's dictionaries alone: characters, windows, lengths and curve by plain means."""

    def byte(c):
        if ord(c) >= 0x250:
            return 128 + (ord(c) ^ (ord(c) >> 7)) % 128
        low = ord(c.lower()[0])
        return low if low < 256 else 128 + low % 128

    raw = bytes(byte(c) for c in text or "")
    words = list(re.finditer(rb"[^ \t\n\x0b\x0c\r]+", raw))
    parts = [b" " + raw[words[k].start() : words[min(k + model.window, len(words)) - 1].end()] + b" " for k in range(0, len(words), model.window)]
    lengths = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        options = zstandard.ZstdCompressionParameters(window_log=15, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        lengths.append([len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options).compress(p)) for p in parts])
    gains = [a - b for a, b in zip(*lengths, strict=True)]
    total, n = sum(max(g, 0) for g in gains), len(gains)
    features = [1, math.log1p(total), math.log1p(sum(g >= 2 for g in gains)), math.log1p(n), min(total / max(n, 1), 1)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(f * w for f, w in zip(features, model.weights, strict=True))))))


def test_whole_scores_by_hand(spark, toxic_model):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, toxic_model).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and len(texts) >= 200
    for k in sorted(texts)[::3]:
        assert got[k] == pytest.approx(score_by_hand(texts[k], toxic_model), abs=1e-12)


def test_toxicity_of_odd_texts(documents, toxic_model):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "you stupid worthless idiot, loser and scum"), (4, "x" * 300_000), (4, "x"), (5, "é中😀 " * 5)]
    got = toxicity.toxicity(documents(*rows, extra=True), toxic_model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    frame = documents(*rows, extra=True)
    kept = toxicity.drop_toxic(frame, toxic_model)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5}
    assert toxicity.toxicity(documents(), toxic_model).count() == 0


def test_nothing_to_learn_from(spark, documents):
    model = toxicity.fit(documents((1, "a")), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.toxicity(documents((1, "a"), (2, None)), model).where("predicted = 1").count() == 0


def test_contrast_finds_the_strings_of_one_class():
    rng = np.random.default_rng(0)
    plain = [" ".join(f"w{k}x" for k in rng.integers(0, 50, 40)) for _ in range(120)]
    texts = plain + [p.replace(" w7x ", " grumblefutz ") + " grumblefutz" for p in plain[:30]]
    labels = np.array([False] * 120 + [True] * 30)
    found = toxicity._contrast(texts, labels, toxicity.ToxicityConfig())
    assert b"grumblefutz" in found


def test_held_out_languages(spark):
    docs = table(spark, SF, "documents")
    rows = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.98
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)


def test_sums_against_a_loop():
    config = language_id.LanguageConfig(bits=8)
    tables = np.random.default_rng(0).normal(size=(3, 256))
    texts = ["", "ab", "Hello wörld", "", "x", "1234"]
    points = [language_id._folded()[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for t in texts]
    cuts = np.concatenate(([0], np.cumsum([len(p) for p in points])))
    got = language_id.sums(np.concatenate(points), cuts, config, tables)
    for row, p in zip(got, points, strict=True):
        want = sum((tables[:, language_id._columns(p, n, 8)].sum(axis=1) for n in config.orders if len(p) >= n), np.zeros(3))
        assert np.allclose(row, want)


def test_blocks_change_nothing(monkeypatch):
    config = language_id.LanguageConfig(bits=8)
    tables = np.random.default_rng(0).normal(size=(2, 256))
    points = language_id._folded()[np.frombuffer(("some words " * 40).encode("utf-32-le"), np.uint32)]
    cuts = np.array([0, 7, 7, 100, len(points)])
    whole = language_id.sums(points, cuts, config, tables)
    monkeypatch.setattr(language_id, "BLOCK", 5)
    assert np.allclose(language_id.sums(points, cuts, config, tables), whole)


def test_language_of_odd_texts(spark, documents):
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs)
    rows = [(1, None), (2, ""), (3, "123 ... !!"), (None, "the and of that is"), (4, "der die und " * 30_000), (4, "der die und nicht")]
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(documents(*rows, extra=True), model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de")}
    assert language_id.identify(documents(), model).count() == 0
    empty = language_id.fit(docs.limit(0))
    assert [r.lang_pred for r in language_id.identify(documents((1, "a")), empty).collect()] == ["und"]


def test_window_gains_by_plain_compression(toxic_model):
    texts = ["you stupid worthless idiot, what a loser and scum of a clown", "the and of that is " * 9, "", "é réeuxment " * 20, "x"]
    scorer = toxicity.Scorer(toxic_model)
    data, offsets = toxicity._lowered(texts)
    parts, rows = toxicity.windows(data, offsets, toxic_model.window)
    kind = zstandard.DICT_TYPE_RAWCONTENT
    want, owner = [], []
    for row, text in enumerate(texts):
        words = [bytes(toxicity._alphabet()[ord(c)] for c in w) for w in text.split()]
        for k in range(0, len(words), 8):
            part = b" " + b" ".join(words[k : k + 8]) + b" "
            plain, both = (len(toxicity.Scorer._compressor(x).compress(part)) for x in (toxic_model.ordinary, toxic_model.toxic + toxic_model.ordinary))
            for content, size in ((toxic_model.ordinary, plain), (toxic_model.toxic + toxic_model.ordinary, both)):
                own = toxicity.Scorer._compressor(content).compress(part)
                assert len(own) == size and zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind)).decompress(own, max_output_size=1 << 12) == part
            want.append(plain - both)
            owner.append(row)
    assert scorer.gains(parts).tolist() == want and rows.tolist() == owner
    assert max(w for w, r in zip(want, owner, strict=True) if r == 0) > 0


def test_toxic_fit_takes_odd_rows(spark, documents):
    rows = [(k, f"w{k % 7} you stupid clown w{k % 5} w{k}" if k % 2 else f"w{k % 7} fine words w{k % 5} w{k}") for k in range(60)]
    odd = [(None, "a"), (1, "other text"), (1, "other text"), (61, None), (62, ""), (63, "long words " * 9000)]
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(64)] + [(None, 0, 1), (2, 0, None), (3, 0, 7), (3, 0, 0)], "doc_id long, quality int, toxic int")
    one, two = (toxicity.fit(documents(*r, extra=True), labels) for r in (rows + odd, odd[::-1] + rows[::-1]))
    assert one == two
    assert toxicity.drop_toxic(documents(), one).count() == 0


def test_long_rows_teach_languages(spark):
    rows = [(k, ("uno dos tres " if k % 2 else "eins zwei drei ") * 2000, "aa" if k % 2 else "bb") for k in range(60)]
    docs = spark.createDataFrame(rows + [(70, None, "aa"), (None, "x", "aa"), (71, "y", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id < 60").collect()
    assert model.languages == ("aa", "bb") and all(r.lang_pred == r.lang for r in got)


def test_predictions_against_plain_naive_bayes(spark):
    docs = table(spark, SF, "documents").where("length(text) < 600")
    config = language_id.LanguageConfig()
    model = language_id.fit(docs, config)

    def columns(text):
        points = [int(language_id._folded()[ord(c)]) for c in text]
        for n in config.orders:
            for k in range(len(points) - n + 1):
                x = n
                for p in points[k : k + n]:
                    x = ((x ^ p) * 0x9E3779B1) & 0xFFFFFFFF
                    x ^= x >> 15
                yield ((x * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - config.bits)

    for r in language_id.identify(docs, model, config).join(docs.select("doc_id", "text"), "doc_id").limit(40).collect():
        sums = model.log_prior.copy()
        for c in columns(r.text):
            sums += model.log_prob[:, c]
        assert r.lang_pred == model.languages[int(sums.argmax())]
        assert abs(r.score - 1 / np.exp(sums - sums.max()).sum()) < 1e-6
