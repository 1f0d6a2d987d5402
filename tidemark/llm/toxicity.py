"""Toxicity by compression distance (operator 5).

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. A text is cut into windows of a few
words, and each window is compressed with the ordinary dictionary and with the toxic one before it; a window that becomes
shorter holds strings that toxic text repeats and ordinary text does not. The bytes gained over the whole text are
calibrated to a probability on folds whose dictionaries have not seen them.

Toxic text is mostly ordinary text, and a trainer that takes its most frequent strings would learn "the" twice, as trials
with whole toxic windows showed. So the toxic dictionary is trained on what sets toxic rows apart: of each one, the runs of
byte 5-grams which toxic rows hold more often than chance allows, so that strings of a small part of them, such as one
language, count as well as those of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.storage import piece_of, texts


@dataclass(frozen=True)
class ToxicityConfig:
    """toxic_rows, ordinary_rows, fit_chars: the fit takes at most so many labelled rows of each class, those of least
    hash, and of a longer row a piece of so many characters, at a place chosen by a hash; fit_windows: and at most so many
    windows, evenly spaced, for the ordinary dictionary. These bound the fit alone. window: words. gram: bytes of a
    contrasting string. evidence: least likelihood ratio G for toxic rows holding it more often. folds: of the calibration.
    threshold: of `predicted`. ordinary_bytes, toxic_bytes: of the dictionaries."""

    toxic_rows: int = 800
    ordinary_rows: int = 3200
    fit_chars: int = 4000
    fit_windows: int = 20_000
    window: int = 8
    gram: int = 5
    evidence: float = 25.0
    folds: int = 2
    threshold: float = 0.7
    ordinary_bytes: int = 2048
    toxic_bytes: int = 1536


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    window: int


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """A byte for each code point: lower-cased Latin-1 as it is, other characters folded into the upper half, so that a
    character is one byte to zstandard and no match ends inside one."""
    points = np.arange(0x110000, dtype=np.uint32)
    table = (128 + (points ^ (points >> 7)) % 128).astype(np.uint8)
    for c in range(0x250):
        low = ord(chr(c).lower()[0])
        table[c] = low if low < 256 else 128 + low % 128
    return table


def one_byte(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 rows in the alphabet of one byte a character."""
    cuts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    return _alphabet()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)], cuts


def _lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [f" {t} ".encode() for t in texts]
    return one_byte(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))


def _contrast(texts: list[str], toxic: np.ndarray, config: ToxicityConfig) -> bytes:
    """The toxic dictionary, trained on the contrasting stretches of each toxic row."""
    data, offsets = _lowered(texts)
    data = np.where(K.BLANK[data], np.uint8(32), data)
    n = config.gram
    if len(data) < n or not toxic.any() or toxic.all():
        return b""
    #: Grams are counted by hash in 2**24 cells, some documents at a time, so the driver holds 4 bytes a character and the
    #: cells, whatever the grams.
    held = np.full(len(data), -1, np.int32)
    counts = np.zeros((2, 1 << 24), np.uint16 if len(texts) < 1 << 16 else np.uint32)
    for first in range(0, len(texts), 200):
        last = min(first + 200, len(texts))
        start, end = int(offsets[first]), int(offsets[last])
        if end - start < n:
            continue
        code = np.zeros(end - start - n + 1, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[start + k : end - n + 1 + k]
        cells = (K.mix(code) >> np.uint64(40)).astype(np.int32)
        row = np.searchsorted(offsets, np.arange(start, start + len(code)), "right") - 1
        inside = np.arange(start, start + len(code)) + n <= offsets[row + 1]
        held[start : start + len(code)] = np.where(inside, cells, -1)
        pairs = np.unique(cells[inside].astype(np.int64) * len(texts) + row[inside])
        cell, owner = pairs // len(texts), pairs % len(texts)
        for kind in (0, 1):
            np.add.at(counts[kind], cell[toxic[owner] == bool(kind)], 1)
    likely = np.flatnonzero(counts[1] >= 3)
    in_toxic, in_ordinary = counts[1][likely].astype(np.int64), counts[0][likely].astype(np.int64)
    rows_with = in_toxic + in_ordinary
    share = toxic.sum() / len(texts)
    evidence = 2 * (in_toxic * np.log(in_toxic / (rows_with * share)) + in_ordinary * np.log(np.maximum(in_ordinary, 1) / (rows_with * (1 - share))))
    chosen = np.zeros(1 << 24, bool)
    chosen[likely[(in_toxic > rows_with * share) & (evidence >= config.evidence)]] = True
    of_toxic = np.repeat(toxic, np.diff(offsets))
    hit = chosen[held] & (held >= 0) & of_toxic
    samples: dict[int, set[bytes]] = {}
    for a, b in _runs(hit, n, len(data)).tolist():
        samples.setdefault(int(np.searchsorted(offsets, a, "right")), set()).add(data[a:b].tobytes())
    #: Stretches stand apart, so that no match runs from one into the next.
    return trained([b"\0".join(sorted(x)) + b"\0" for x in samples.values()], config.toxic_bytes)


def _runs(hit: np.ndarray, n: int, size: int) -> np.ndarray:
    """(start, end) of the stretches that n-grams at `hit` cover."""
    cover = np.zeros(size + 1, np.int16)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    covered = np.cumsum(cover[:-1], dtype=np.int16) > 0
    return np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))).reshape(-1, 2)


def _ordinary(texts: list[str], config: ToxicityConfig) -> bytes:
    """The ordinary dictionary, trained on windows."""
    samples = windows(*_lowered(texts), config.window)[0]
    return trained(samples[:: 1 + len(samples) // config.fit_windows], config.ordinary_bytes) or b"the and of to "


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes by zstandard's trainer; of fewer samples than it takes, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray]:
    """(the windows, the row of each): runs of `size` words of lowered rows, with one blank before and after."""
    starts, ends, rows = K.words(data, offsets)
    if not len(starts):
        return [], np.empty(0, np.int64)
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = np.flatnonzero(rank % size == 0)
    last = np.concatenate((first[1:], [len(rows)])) - 1
    raw = data.tobytes()
    return [b" " + raw[a:b] + b" " for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], rows[first]


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.plain, self.both = (self._compressor(x) for x in (model.ordinary, model.toxic + model.ordinary))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = zstandard.ZstdCompressionParameters(window_log=15, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        dictionary.precompute_compress(compression_params=options)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options)

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        plain, both = self.plain.compress, self.both.compress
        return np.fromiter((len(plain(x)) - len(both(x)) for x in parts), np.int64, len(parts))

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row: 1, log of the bytes gained, of the windows with a clear gain, and of all windows."""
        parts, rows = windows(data, offsets, self.model.window)
        n = len(offsets) - 1
        gain = self.gains(parts)
        total = np.bincount(rows, np.maximum(gain, 0), n)
        clear = np.bincount(rows[gain >= 2], minlength=n)
        count = np.bincount(rows, minlength=n)
        return np.column_stack((np.ones(n), np.log1p(total), np.log1p(clear), np.log1p(count), np.minimum(total / np.maximum(count, 1), 1.0)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(data, offsets) @ np.array(self.model.weights), -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the sample's share of toxic rows stands for the prior."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], labels: list[int], config: ToxicityConfig = ToxicityConfig(), share: float | None = None) -> ToxicityModel:
    """share: of toxic rows among those that scores are for, if the sample's own is another. Without rows of both classes: a
    model that gives each text 0."""
    y = np.array(labels, bool)
    if not y.any() or y.all():
        return ToxicityModel(b"the and of to ", b"", (-30.0, 0.0, 0.0, 0.0, 0.0), config.window)

    def dictionaries(keep: np.ndarray) -> tuple[bytes, bytes]:
        chosen = [texts[k] for k in np.flatnonzero(keep)]
        return _ordinary([texts[k] for k in np.flatnonzero(keep & ~y)], config), _contrast(chosen, y[keep], config)

    fold = np.arange(len(texts)) % config.folds
    x = np.zeros((len(texts), 5))
    for f in range(config.folds):
        model = ToxicityModel(*dictionaries(fold != f), (0.0,) * 5, config.window)
        own = np.flatnonzero(fold == f)
        if len(own):
            x[own] = Scorer(model).features(*_lowered([texts[k] for k in own]))
    weights = _calibrate(x, y)
    if share is not None and 0 < share < 1:
        weights[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return ToxicityModel(*dictionaries(np.ones(len(texts), bool)), tuple(weights.tolist()), config.window)


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Learn from labelled rows whose crc32(doc_id) mod 3 is not 1, within the bounds of `config`.

    Null texts, ids and labels, and labels other than 0 and 1, teach nothing; an id labelled both ways is toxic. Without
    rows of both classes the model gives each text 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    order = F.xxhash64("doc_id", F.lit(5))
    bounds = {1: config.toxic_rows, 0: config.ordinary_rows}
    ids = None
    for kind, most in bounds.items():
        own = known.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most)
        ids = own if ids is None else ids.union(own)
    piece = piece_of(F.col("text"), F.xxhash64("doc_id", F.lit(6)), config.fit_chars)
    found = texts(docs).where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", piece.alias("text"))
    #: Rows that share an id are one, that of the least text, so the fit doesn't hang on the order of rows.
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    toxic, every = known.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    return train(rows.text.tolist(), rows.toxic.tolist(), config, toxic / every if every else None)


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.scores(*one_byte(data, offsets)) for _, _, data, offsets in K.slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs`; only doc_id and text are read, only the text is
    scored, and all of it.

    Null and empty texts and texts without words score as a text that gains nothing. A null doc_id is not held out.
    Repeated rows are scored each. An empty table gives an empty result.
    """
    read = texts(docs)
    scored = read.mapInArrow(_score(model), "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))


def _judge(model: ToxicityModel, threshold: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.scores(*one_byte(data, offsets)) for _, _, data, offsets in K.slices(batch.column(column).cast(pa.string()))]
            yield batch.filter(pa.array((np.concatenate(scores) if scores else np.empty(0)) < threshold))

    return run


def drop_toxic(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of `docs`, with all their columns, whatever their names, that the model doesn't predict to be toxic; no
    shuffle. Rows are judged one by one by their whole text: null and empty texts stay, repeated rows stay or go together,
    ids aren't read. An empty table gives an empty result.
    """
    texts(docs)  # for its small batches
    return docs.mapInArrow(_judge(model, config.threshold, docs.columns.index("text")), docs.schema)
