"""Batch tokenisation by a public byte-level BPE vocabulary.

`tokenizers` gives the ids. Byte-level BPE never merges across the pieces of its pre-tokeniser, and a corpus repeats most
pieces, so texts are cut into pieces in numpy by the pre-tokeniser's rule, distinct pieces are encoded once by
`tokenizers`, and ids are gathered by piece.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from tidemark.llm import textkernel as K

OTHER, LETTER, NUMBER, BLANK, END = 0, 1, 2, 3, 4
#: Distinct pieces that a worker keeps at most before it starts anew; bounds its memory, never its results.
MEMO = 1_500_000
#: The vocabulary's character for each byte: itself if it prints, else the next one from 256 on.
PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTS)}
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, index = "".join(map(chr, points)), np.array(points)
    table = np.zeros(0x110000, np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[index[m.start() : m.end()]] = kind
    return table


def pieces(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded code points, start, end, row) of the pieces of texts of these lengths, given as their joined code points.

    A piece is a contraction ('s 't 'm 'd 're 've 'll), or letters, or numbers, or other characters, each with one space
    before it if there is one, or blanks: those before a blank that a piece or itself alone follows, or at the end all.
    """
    ends = np.cumsum(lengths)
    padded = np.insert(points, ends, 0)
    marks = ends + np.arange(len(ends))
    kind = _classes()[padded]
    kind[marks] = END
    before = np.concatenate(([END], kind[:-1]))
    after = np.concatenate((kind[1:], [END]))
    blank = kind == BLANK
    space = blank & (padded == 32)
    led = np.concatenate(([False], space[:-1]))  # the character before is a space, which goes with the piece
    start = (kind != before) & ~blank & (kind != END) & ~led
    start |= blank & (before != BLANK)
    start |= blank & (after != BLANK) & (after != END)
    at = np.flatnonzero((padded == 39) & start & (after == LETTER))
    if len(at):
        one, two = padded[at + 1], padded[np.minimum(at + 2, len(padded) - 1)]
        size = np.zeros(len(at), np.int64)
        for c in CONTRACTIONS:
            fits = (one == ord(c[0])) if len(c) == 1 else (one == ord(c[0])) & (two == ord(c[1]))
            size[fits & (size == 0)] = len(c)
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        nxt = at + 1 + size
        start[nxt] |= (kind[nxt] == LETTER) | start[nxt]
    starts = np.flatnonzero(start)
    stops = np.concatenate((starts[1:], [len(padded)]))
    rows = np.searchsorted(marks, starts)
    return padded, starts, np.minimum(stops, marks[rows]) if len(starts) else stops[:0], rows


def _cuts_as_we_do(path: str) -> bool:
    """Whether the vocabulary is byte-level BPE over texts as they are, cut by the rule of `pieces`."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    cut = made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and made.get("truncation") is None and made.get("padding") is None
    return plain and made["model"].get("type") == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not made["model"].get("ignore_merges")


class Encoder:
    """Ids of texts by the vocabulary in `path`, a file of `tokenizers`. One that isn't byte-level BPE with the rule of
    `pieces` is left to `tokenizers` whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = _cuts_as_we_do(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.begins, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        merge = self.tokenizer.model.tokenize  # a piece needs the merges alone, which spares the rest of encode()
        found = [[token.id for token in merge(x.encode().decode("latin-1").translate(BYTE_CHARACTERS))] for x in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        begins = len(self.ids) + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        slots = len(self.begins) + np.arange(len(hashes))
        self.ids, self.begins, self.sizes = np.concatenate((self.ids, flat)), np.concatenate((self.begins, begins)), np.concatenate((self.sizes, sizes))
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, where, hashes), np.insert(self.slots, where, slots)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of rows in them) of UTF-8 rows."""
        n = len(offsets) - 1
        if not self.by_pieces:
            raw = data.tobytes()
            found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(f.ids for f in found), np.int32, sum(len(f.ids) for f in found))
            return ids, np.concatenate(([0], np.cumsum([len(f.ids) for f in found]))).astype(np.int64)
        heads = (data & 0xC0) != 0x80
        lengths = np.diff(np.concatenate(([0], np.cumsum(heads)))[offsets])
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        padded, starts, stops, rows = pieces(points, lengths)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        hashed = K.segment_hashes(padded, starts, stops)
        distinct, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.hashes) > MEMO:
            self._clear()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            s, e = starts[first[new]], stops[first[new]]
            text = padded.tobytes().decode("utf-32-le", "surrogatepass")
            self._learn(distinct[new], [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        slots = self.slots[at][inverse]
        sizes = self.sizes[slots]
        before = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.repeat(self.begins[slots] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[np.searchsorted(rows, np.arange(n + 1))]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps its memo from batch to batch."""
    return Encoder(path)


def encoded(column: pa.Array, path: str):
    """(first row, ids of each row with nothing added) slice by slice."""
    for first, last, data, offsets in K.slices(column, 1 << 20):
        ids, cuts = encoder(path).encode(data, offsets)
        yield first, [ids[cuts[k] : cuts[k + 1]] for k in range(last - first)]


def vocabulary(path: str | None = None) -> str:
    """The vocabulary's file: a parameter, by default the installed public one."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
