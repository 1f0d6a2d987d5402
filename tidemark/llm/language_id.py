"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 7).

The log-probability matrix (languages x 2**bits) is the model and is sent to the executors; its size follows the number of
languages alone. Texts are scored in numpy: code points are hashed into n-gram columns, each language gathers its row at
those columns and sums them by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.storage import piece_of, texts


@dataclass(frozen=True)
class LanguageConfig:
    """orders: lengths of the n-grams. bits: of a column. alpha: added to each count. rows_per_language, fit_chars,
    languages: the fit takes about so many rows of each language (by a hash, at most twice as many in all), of a longer one
    a piece of so many characters at a place chosen by a hash, and the most frequent languages; this bounds the fit and the
    model alone."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    alpha: float = 0.5
    rows_per_language: int = 400
    fit_chars: int = 4000
    languages: int = 256


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray


@lru_cache(1)
def _folded() -> np.ndarray:
    """Code points lower-cased where that is one code point; all that are no letters are one blank."""
    table = np.full(0x110000, 32, np.uint32)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, index = "".join(map(chr, points)), np.array(points)
    for m in regex.finditer(r"\p{L}+", text):
        table[index[m.start() : m.end()]] = index[m.start() : m.end()]
    for c in range(0x1E944):
        if table[c] != 32 and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


def _columns(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The column of the n-gram at each of the first len(points) - order + 1 places."""
    n = len(points) - order + 1
    x = np.full(n, order, np.uint32)
    for k in range(order):
        x = (x ^ points[k : n + k]) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
    return (x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


BLOCK = 1 << 18


def sums(points: np.ndarray, cuts: np.ndarray, config: LanguageConfig, tables: np.ndarray) -> np.ndarray:
    """(texts, tables): each table summed over the n-gram columns of each text, block by block."""
    n = len(cuts) - 1
    out = np.zeros((n, len(tables)))
    for order in config.orders:
        last = np.maximum(cuts[1:] - order + 1, cuts[:-1])  # the end of the places where an n-gram of the text starts
        for a in range(0, len(points), BLOCK):
            b = min(a + BLOCK, len(points) - order + 1)
            if b <= a:
                break
            columns = _columns(points[a : b + order - 1], order, config.bits)
            first, stop = np.searchsorted(cuts, a, "right") - 1, np.searchsorted(cuts[:-1], b, "left")
            rows = np.arange(first, stop)
            s, e = np.clip(cuts[rows], a, b) - a, np.clip(last[rows], a, b) - a
            rows, s, e = rows[e > s], s[e > s], e[e > s]
            if not len(rows):
                continue
            edges = np.column_stack((s, e)).ravel()
            if edges[-1] == len(columns):
                edges = edges[:-1]
            for t, table in enumerate(tables):
                out[rows, t] += np.add.reduceat(table[columns], edges)[::2]
    return out


def train(texts: list[str], languages: list[str], config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    names = tuple(sorted(set(languages)))
    counts = np.full((len(names), 1 << config.bits), config.alpha)
    rows = np.zeros(len(names))
    for k, name in enumerate(names):
        own = [t for t, x in zip(texts, languages, strict=True) if x == name]
        rows[k] = len(own)
        for text in own:
            points = _folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            for order in config.orders:
                if len(points) >= order:
                    counts[k] += np.bincount(_columns(points, order, config.bits), minlength=1 << config.bits)
    return LanguageModel(names, np.log(rows / max(rows.sum(), 1)) if len(names) else rows, np.log(counts / counts.sum(axis=1, keepdims=True)))


def fit(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Learn from text and lang of rows whose crc32(doc_id) mod 5 is not 0, within the bounds of `config`."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("lang is not null and doc_id is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.languages).collect()
    if not counts:
        return LanguageModel((), np.zeros(0), np.zeros((0, 1 << config.bits)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, config.rows_per_language / r["count"]) * (1 << 30))))])
    piece = piece_of(F.col("text"), F.xxhash64("doc_id", F.lit(8)), config.fit_chars)
    rows = known.where((draw < share[F.col("lang")]) & F.col("text").isNotNull()).select("doc_id", "lang", piece.alias("text"))
    rows = rows.orderBy(draw, "doc_id", "text").limit(2 * config.rows_per_language * len(counts)).toPandas()
    return train(rows.text.tolist(), rows.lang.tolist(), config)


def _predict(model: LanguageModel, config: LanguageConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for first, last, data, offsets in K.slices(batch.column(1)):
                cuts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
                points = _folded()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
                letters = np.concatenate(([0], np.cumsum(points != 32)))[cuts]
                known = (np.diff(letters) > 0) & bool(len(model.languages))
                best, score = np.full(last - first, len(model.languages)), np.zeros(last - first)
                if known.any():
                    likely = sums(points, cuts, config, model.log_prob) + model.log_prior
                    odds = np.exp(likely - likely.max(axis=1, keepdims=True))
                    top = likely.argmax(axis=1)
                    best = np.where(known, top, best)
                    score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of `docs`; only doc_id and text are read, only the text is
    used, and all of it. score: the posterior of the predicted language.

    Null texts and texts without a letter: `und` with score 0; so is every text if nothing was learned. Ties go to the
    language that sorts first. A null doc_id is not held out. An empty table gives an empty result.
    """
    read = texts(docs)
    found = read.mapInArrow(_predict(model, config), "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
