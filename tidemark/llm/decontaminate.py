"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 6).

The word n-grams that few test items share are seeds, however many documents hold them. A common one, such as the opening
of a template, says nothing of which item a text holds, so it counts for those items alone of which a rare word stands near
it too; no alignment can do without one, unless an item has next to no rare words, and then all its n-grams are seeds. Hits
of an item's seeds in a document are grouped by the diagonal, and the item is aligned with the passage around each group by
Smith-Waterman over words, which scores edited copies. A group is passed over only where the passage lacks so many of
the item's words that no alignment could reach the threshold. A passage that shares no run of `words` words with an item has
no seed and isn't found. An item too short for seeds is found where its whole sequence of words stands. Items of equal
words are aligned once.

Texts never move: the items' n-grams are sent to the executors, in blocks of a bounded size, and no document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.storage import texts


@dataclass(frozen=True)
class DecontaminationConfig:
    """words: of a seed. min_words: items of fewer words are matched exactly, as a whole. match, mismatch, gap: of the alignment. threshold: least alignment score as a
    share of the item's best possible. rare: items that hold a rare seed or word at most. block_words: words of test items that are sent to the executors at once (8 bytes each, and
    32 for each seed); more items take more passes."""

    words: int = 3
    min_words: int = 6
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.55
    rare: int = 16
    block_words: int = 1_000_000


#: Hits that are spread over items at once; more are taken by ranges of items.
SPREAD = 1 << 20


@dataclass
class Items:
    ids: list[list[int]]  # of each item of other words, the ids that have them
    words: list[np.ndarray]
    grams: np.ndarray  # distinct, ascending
    gram: np.ndarray  # of each place, its number in `grams`
    item: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # of each length of short items, their hashes, ascending, and ids


def parse(ids: list[int], texts: list[str | None], config: DecontaminationConfig) -> Items:
    found: list[np.ndarray] = []
    for first, last, data, offsets in K.slices(pa.array(texts, pa.string())):
        starts, ends, rows = K.words(data, offsets, K.PUNCTUATION)
        found += np.split(K.word_hashes(data, starts, ends), np.searchsorted(rows, np.arange(1, last - first)))
    least = max(config.min_words, config.words)
    short = {}
    for n in sorted({len(w) for w in found} & set(range(1, least))):
        own = [k for k, w in enumerate(found) if len(w) == n]
        hashes = K.ngrams(np.concatenate([found[k] for k in own]), np.repeat(np.arange(len(own)), n), n)[0]
        by = np.argsort(hashes, kind="stable")
        short[n] = hashes[by], np.array(ids, np.int64)[own][by]
    distinct: dict[bytes, list[int]] = {}
    for k, w in enumerate(found):
        if len(w) >= least:
            distinct.setdefault(w.tobytes(), []).append(k)
    own, words = [[ids[k] for k in same] for same in distinct.values()], [found[same[0]] for same in distinct.values()]
    if not words:
        none = np.empty(0, np.int64)
        return Items([], [], np.empty(0, np.uint64), none, none, none, short)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    hashed, at = K.ngrams(np.concatenate(words), owner, config.words)
    begin = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    grams, gram = np.unique(hashed, return_inverse=True)
    return Items(own, words, grams, gram, owner[at], at - begin[owner[at]], short)


class Holders:
    """Which items hold a number (of an n-gram or a word), and where: spread(at, slot) gives (at, item, place) for each place
    of each item that holds slot's number, in bounded runs by ranges of items."""

    def __init__(self, number: np.ndarray, item: np.ndarray, place: np.ndarray, items: int):
        order = np.lexsort((place, item, number))
        self.items, self.item, self.place = items, item[order], place[order]
        self.keys = number[order] * items + self.item

    def spread(self, at: np.ndarray, slot: np.ndarray, low: int = 0, high: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        high = self.items if high is None else high
        begin = np.searchsorted(self.keys, slot * self.items + low)
        many = np.searchsorted(self.keys, slot * self.items + high) - begin
        held = np.flatnonzero(many)
        at, slot, begin, many = at[held], slot[held], begin[held], many[held]
        if int(many.sum()) > SPREAD and high - low > 1:
            middle = (low + high) // 2
            yield from self.spread(at, slot, low, middle)
            yield from self.spread(at, slot, middle, high)
        elif len(at):
            source = K.runs(begin, many)
            yield np.repeat(at, many), self.item[source], self.place[source]


def _items_each(number: np.ndarray, item: np.ndarray, numbers: int, items: int) -> np.ndarray:
    """How many items hold each number."""
    return np.bincount(np.unique(number * items + item) // items, minlength=numbers)


def _hits(hashed: np.ndarray, rows: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of hits, their gram numbers)."""
    found, at = K.ngrams(hashed, rows, n)
    if not len(found) or not len(grams):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    slot = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
    hit = grams[slot] == found
    return at[hit], slot[hit]


def align(item: np.ndarray, passage: np.ndarray, config: DecontaminationConfig) -> tuple[int, int]:
    """(best local alignment score, end of the aligned passage). Rows of the matrix are items' words; gaps along a row are
    a running maximum."""
    step = -config.gap
    row = np.zeros(len(passage) + 1, np.int64)
    ramp = np.arange(len(passage) + 1) * step
    best, end = 0, 0
    for word in item:
        to = np.empty_like(row)
        to[0] = 0
        to[1:] = np.maximum(row[:-1] + np.where(passage == word, config.match, config.mismatch), row[1:] + config.gap)
        np.maximum(to, 0, out=to)
        row = np.maximum.accumulate(to + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def begin_of(item: np.ndarray, passage: np.ndarray, config: DecontaminationConfig) -> int:
    """Where the best local alignment of an item starts that ends at the end of the passage: the recurrence of `align`,
    each cell with the start of its alignment."""
    step = -config.gap
    places = np.arange(len(passage) + 1)
    row, since = np.zeros(len(passage) + 1, np.int64), places.copy()
    best, start = 0, len(passage)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, config.match, config.mismatch)
        up = row[1:] + config.gap
        to, origin = np.zeros_like(row), places.copy()
        to[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin[1:] = np.where(to[1:] == 0, places[1:], np.where(diagonal >= up, since[:-1], since[1:]))
        climbed = np.maximum.accumulate(to + places * step)
        source = np.maximum.accumulate(np.where(to + places * step == climbed, places, 0))
        row = climbed - places * step
        since = np.where(row > 0, origin[source], places)
        if row[-1] > best:
            best, start = int(row[-1]), int(since[-1])
    return start


PAIR_SCHEMA = "doc_id long, item_id long, score double, word_start long, word_end long"


def _finder(items: Items, config: DecontaminationConfig):
    """column of texts -> (row, item id, score, start, end) of the passages that hold an item, slice by slice; words count
    from 0 in a text."""
    n, many = config.words, len(items.words)
    sizes = np.array([len(w) for w in items.words], np.int64)
    common = _items_each(items.gram, items.item, len(items.grams), many) > config.rare
    shared = common[items.gram]
    flat, owner = np.concatenate([np.empty(0, np.uint64), *items.words]), np.repeat(np.arange(many), sizes)
    vocabulary, word = np.unique(flat, return_inverse=True)
    usual = _items_each(word, owner, len(vocabulary), many) > config.rare
    # items whose usual words alone could make a match, so that all their n-grams are seeds
    plain = np.bincount(owner, usual[word], many) >= config.threshold * sizes
    seeds = Holders(*(x[~shared | plain[items.item]] for x in (items.gram, items.item, items.place)), many)
    templates = Holders(*(x[shared & ~plain[items.item]] for x in (items.gram, items.item, items.place)), many)
    templated = np.zeros(many, bool)
    templated[templates.item] = True
    telling = ~usual[word] & templated[owner]
    words = Holders(*(x[telling] for x in (word, owner, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner])), many)

    def spread(at: np.ndarray, slot: np.ndarray, hashed: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the slice, item, place in the item) of seeds; no item's hits are parted."""
        yield from seeds.spread(at, slot)
        at, slot = at[common[slot]], slot[common[slot]]
        if not len(at) or not len(templates.item):
            return
        in_row = np.zeros(int(rows[-1]) + 1, bool)
        in_row[rows[at]] = True
        near = np.flatnonzero(in_row[rows])
        known = np.minimum(np.searchsorted(vocabulary, hashed[near]), len(vocabulary) - 1)
        told = vocabulary[known] == hashed[near]
        pairs = [np.empty(0, np.int64)]
        for where, item, place in words.spread(near[told], known[told]):
            start = where - place
            low, high = np.maximum(start - sizes[item], np.searchsorted(rows, rows[where])), np.minimum(start + 2 * sizes[item], np.searchsorted(rows, rows[where], "right"))
            beside = np.searchsorted(at, high) > np.searchsorted(at, low)  # a template's n-gram within the item's reach
            pairs.append(np.unique(rows[where[beside]] * many + item[beside]))
        pairs = np.unique(np.concatenate(pairs))
        # the templates' n-grams count for these pairs of row and item alone
        for row in np.unique(pairs // many).tolist():
            own = pairs[np.searchsorted(pairs, row * many) : np.searchsorted(pairs, (row + 1) * many)] % many
            a, b = np.searchsorted(rows[at], row), np.searchsorted(rows[at], row, "right")
            for item in own.tolist():
                yield from templates.spread(at[a:b], slot[a:b], item, item + 1)

    def find(column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        for first, _, data, offsets in K.slices(column):
            starts, ends, rows = K.words(data, offsets, K.PUNCTUATION)
            hashed = K.word_hashes(data, starts, ends)
            for size, (hashes, ids) in items.short.items():
                found, at = K.ngrams(hashed, rows, size)
                low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
                for k in np.flatnonzero(high > low).tolist():
                    own = int(at[k]) - int(np.searchsorted(rows, rows[at[k]]))
                    for item in ids[low[k] : high[k]].tolist():
                        yield first + int(rows[at[k]]), item, 1.0, own, own + size
            at, slot = _hits(hashed, rows, items.grams, n)
            if not len(at):
                continue
            for at_, item, place in spread(at, slot, hashed, rows):
                diagonal, row = at_ - place, rows[at_]
                by = np.lexsort((diagonal, item, row))
                row, item, diagonal = row[by], item[by], diagonal[by]
                size = sizes[item]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > size[1:] // 4 + 2)
                group = np.flatnonzero(new)
                for a, b in zip(group.tolist(), [*group[1:].tolist(), len(row)], strict=True):
                    own = items.words[item[a]]
                    low, high = int(np.searchsorted(rows, row[a])), int(np.searchsorted(rows, row[a], "right"))
                    # no alignment that reaches the threshold is as long as two items: it lies within one of a seed's diagonal,
                    # and long passages are met in windows
                    s, e = max(low, int(diagonal[a]) - len(own)), min(high, int(diagonal[b - 1]) + 2 * len(own))
                    for s_ in range(s, max(s + 1, e - 2 * len(own)), 2 * len(own)):
                        e_ = min(e, s_ + 4 * len(own))
                        passage = hashed[s_:e_]
                        if np.isin(own, passage).sum() < config.threshold * len(own):
                            continue  # each word of the item that the passage has adds `match` at most
                        score, end = align(own, passage, config)
                        share = score / (config.match * len(own))
                        if share >= config.threshold:
                            begin = s_ + begin_of(own, passage[:end], config) - low
                            for i in items.ids[item[a]]:
                                yield first + int(row[a]), i, share, begin, s_ + end - low

    return find


def _passages(items: Items, config: DecontaminationConfig):
    find = _finder(items, config)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(find(batch.column(1)))
            columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], [c.split()[0] for c in PAIR_SCHEMA.split(", ")])

    return run


def _clean(items: Items, config: DecontaminationConfig, column: int):
    find = _finder(items, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[np.fromiter((f[0] for f in find(batch.column(column).cast(pa.string()))), np.int64)] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, config: DecontaminationConfig) -> Iterator[Items]:
    """The items in blocks of about `block_words` words: the only rows that the driver reads."""
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // (4 * config.block_words)
    for k in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = parse([r.item_id for r in own], [r.text for r in own], config)
        if len(items.ids) or items.short:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """(doc_id, item_id, score, word_start, word_end): the documents that hold a test item, each item once with its best
    passage, of equal ones the first. Words are runs of ASCII letters and digits, lower-cased, and of all other non-ASCII
    characters; places are those of the words of the document from 0, the end exclusive.

    Null and empty texts match nothing, neither do items without a word or without an id. Items of fewer than min_words
    words are matched whole, with score 1. Documents without an id are matched and give null doc_ids, one row for each
    item. Repeated documents or items give one row for each pair of ids. Empty tables give an empty result. Texts may be of
    any length; other columns aren't read.
    """
    docs = texts(docs)
    out = docs.sparkSession.createDataFrame([], PAIR_SCHEMA)
    for items in _blocks(benchmark, config):
        out = out.union(docs.mapInArrow(_passages(items, config), PAIR_SCHEMA))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("word_start")).alias("o"), "word_start", "word_end")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.word_start", "b.word_end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """`docs`, with all columns, whatever their names, without the rows that hold a test item. Each row is judged by its own
    whole text and no id is read, so rows with null or repeated ids stay or go by themselves; rows with null or empty texts
    stay. No shuffle: a pass over the rows for each block of items. Empty tables: nothing is dropped.
    """
    texts(docs)  # for its small batches
    for items in _blocks(benchmark, config):
        docs = docs.mapInArrow(_clean(items, config, docs.columns.index("text")), docs.schema)
    return docs
