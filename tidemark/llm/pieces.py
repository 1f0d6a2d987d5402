"""SentencePiece encoding and decoding by a table of prefixes (operator 13).

The library merges, again and again, the neighbouring pair of symbols whose joined piece scores best, the leftmost of equals.
A sequence of pieces is what these merges leave if and only if each neighbouring pair of it is: a merge across a border
would have been chosen in the pair alone too, as merges elsewhere change neither its symbols nor its rank. So each prefix of
a text has one last piece, whatever follows: the piece that ends there and is compatible with the last piece of the prefix
before it. An automaton over the vocabulary gives the pieces that end at a place, the table keeps the one that fits, and
ids are read backwards from its end. Compatibility follows from the merges of the two pieces alone, taken in turn.

No piece holds the blank's sign after another character, so a text is cut before each run of blanks into units that are
encoded by themselves, and the short ones, which a corpus repeats, once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.storage import texts

#: The sign that stands for a blank, and its bytes.
SIGN = "▁"
SIGN_BYTES = SIGN.encode()
#: Kinds of pieces in a model's file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Units of more bytes are encoded each time; units that a worker keeps before it starts anew. Both bound its memory alone.
MEMO_BYTES, MEMO = 64, 1_000_000
#: Pairs of pieces whose compatibility a worker keeps before it starts anew.
PAIRS = 2_000_000
NEVER = -float("inf")


class PrefixTable:
    """Encodes units of text by pieces: [(piece, id, score)], all of whose characters are pieces too. Other characters take
    part in no merge and stay by themselves."""

    def __init__(self, pieces: list[tuple[str, int, float]]):
        self.scores = {piece: score for piece, _, score in pieces}
        self.names = [""] * (1 + max(k for _, k, _ in pieces))
        for piece, k, _ in pieces:
            self.names[k] = piece
        self.sizes = [len(piece) for piece in self.names]
        self.history = lru_cache(1 << 18)(self._history)
        self.automaton = ahocorasick.Automaton()
        for piece, k, _ in pieces:
            if self.history(piece) is not None:  # else no text is merged to it
                self.automaton.add_word(piece, (k, len(piece)))
        self.automaton.make_automaton()
        self.fits: list[dict[int, bool]] = [{} for _ in self.names]
        self.known = 0
        self.barrier = next(c for c in map(chr, range(0x110000)) if c not in self.scores)

    def _history(self, piece: str) -> tuple[list[tuple[float, str, str]], str, str] | None:
        """([(score of a merge, first symbol after it, last symbol after it)], first and last character) of the merges
        that make the piece from its characters; None if they leave more than one symbol."""
        symbols, steps = list(piece), []
        while len(symbols) > 1:
            best = max((self.scores.get(symbols[i] + symbols[i + 1], NEVER), -i) for i in range(len(symbols) - 1))
            if best[0] == NEVER:
                return None
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            steps.append((best[0], symbols[0], symbols[-1]))
        return steps, piece[0], piece[-1]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges of left + right leave these two pieces: no merge across the border is ever the next one."""
        (steps, _, x), (others, y, _) = self.history(left), self.history(right)
        i = j = 0
        while True:
            across = self.scores.get(x + y, NEVER)
            mine = steps[i][0] if i < len(steps) else NEVER
            other = others[j][0] if j < len(others) else NEVER
            if across > mine and across >= other:
                return False
            if mine == other == NEVER:
                return True
            if mine >= other:
                x = steps[i][2]
                i += 1
            else:
                y = others[j][1]
                j += 1

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit; -1 - c for a character c that is no piece. All are met in one walk of the automaton; the
        table's entry of a place is the last piece of the prefix that ends with this character, -1 where none ends."""
        text = self.barrier.join(units)
        last = [-1] * (len(text) + 1)
        if self.known > PAIRS:
            self.fits, self.known = [{} for _ in self.names], 0
        fits, names = self.fits, self.names
        for end, (piece, n) in self.automaton.iter(text):
            if last[end] < 0:
                before = last[end - n]
                if before < 0:  # the first of its unit, or after a character that is no piece
                    last[end] = piece
                else:
                    fit = fits[before].get(piece)
                    if fit is None:
                        fit = fits[before][piece] = self.compatible(names[before], names[piece])
                        self.known += 1
                    if fit:
                        last[end] = piece
        out, begin, sizes = [], -1, self.sizes
        for unit in units:
            end = begin + len(unit)
            own, at = [], end
            while at > begin:
                piece = last[at]
                if piece >= 0:
                    own.append(piece)
                    at -= sizes[piece]
                else:
                    own.append(-1 - ord(text[at]))
                    at -= 1
            own.reverse()
            out.append(own)
            begin = end + 1
        return out


class Encoder:
    """Ids of texts by the model in `path`, a file of `sentencepiece`. A model that isn't a BPE one whose texts stay as they
    are but for the blank's sign, with a fallback to bytes, is left to the library whole."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rule, made = model.normalizer_spec, model.trainer_spec
        pieces = {p.piece: (k, p.score) for k, p in enumerate(model.pieces) if p.type == NORMAL}
        bytes_ = [k for k, p in enumerate(model.pieces) if p.type == BYTE]
        self.by_table = (
            made.model_type == made.BPE and not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces
            and not rule.remove_extra_whitespaces and not made.treat_whitespace_as_suffix and made.byte_fallback and len(bytes_) == 256
            and all(p.type in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces) and not any(SIGN in p.lstrip(SIGN) for p in pieces)
            and SIGN in pieces and pieces.keys() >= set("".join(pieces))
        )
        if self.by_table:
            self.table = PrefixTable([(p, k, score) for p, (k, score) in pieces.items()])
            self.bytes = bytes_
        self.memo: dict[int, bytes] = {}
        # the bytes of each piece, a blank for its sign; pieces of other kinds have none and are left to the library
        raw = [p.piece.replace(SIGN, " ").encode() if p.type == NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" for p in model.pieces]
        self.sizes, self.kinds = np.array([len(r) for r in raw], np.int64), np.array([p.type for p in model.pieces])
        self.places, self.raw = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(raw), np.uint8)

    def units(self, units: list[str]) -> Iterator[bytes]:
        """Ids of units, as 32-bit numbers; a character that is no piece gives one for each of its bytes."""
        for ids in self.table.encode(units):
            if min(ids) < 0:
                ids = [x for i in ids for x in ([i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode()])]
            yield array("i", ids).tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of rows in them) of UTF-8 rows."""
        n = len(offsets) - 1
        raw = data.tobytes()
        if not self.by_table:
            found = [np.array(self.library.encode(raw[a:b].decode()), np.int32) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate([np.empty(0, np.int32), *found]), np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
        starts, ends, leads, rows = units(data, offsets)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        keys = K.mix(K.segment_hashes(data, starts, ends) + leads.astype(np.uint64))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.memo) > MEMO:
            self.memo.clear()
        known = list(map(self.memo.get, distinct.tolist()))
        new = [k for k, ids in enumerate(known) if ids is None]
        if new:
            a, b, lead = (x[first[new]].tolist() for x in (starts, ends, leads))
            for k, i, j, ids in zip(new, a, b, self.units([SIGN * l + raw[i:j].decode().replace(" ", SIGN) for i, j, l in zip(a, b, lead, strict=True)]), strict=True):
                known[k] = ids
                if j - i <= MEMO_BYTES:
                    self.memo[int(distinct[k])] = ids
        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        ids = np.frombuffer(b"".join(known), np.int32)[K.runs(begins[inverse], sizes[inverse])]
        return ids, np.concatenate(([0], np.cumsum(sizes[inverse])))[np.searchsorted(rows, np.arange(n + 1))]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, whether the blank's sign goes before it, row) of the units of UTF-8 rows: each begins with a run of
    blanks or signs, and the first of a row with a sign more."""
    sign = np.zeros(len(data), bool)
    at = np.flatnonzero(data[:-2] == SIGN_BYTES[0])
    at = at[(data[at + 1] == SIGN_BYTES[1]) & (data[at + 2] == SIGN_BYTES[2])]
    begins = data == 0x20
    begins[at] = True
    sign[begins] = True
    sign[at + 1] = sign[at + 2] = True
    begins[1:] &= ~sign[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = True
    starts = np.flatnonzero(begins)
    leads = np.zeros(len(starts), np.int64)
    leads[np.searchsorted(starts, firsts)] = 1
    return starts, np.concatenate((starts[1:], [len(data)])), leads, np.searchsorted(offsets, starts, "right") - 1


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps its memo from batch to batch."""
    return Encoder(path)


def model_file(path: str | None = None) -> str:
    """The model's file: a parameter, by default the installed public one."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in K.slices(batch.column(1)):
                ids, cuts = encoder(path).encode(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text, as the library encodes it without begin or end ids.

    Null and empty texts have no ids. Rows with null or repeated doc_id are rows as any others, extra columns are left out,
    an empty table gives an empty result. Texts may be of any length: time and a worker's memory are in proportion to the
    longest. No shuffle."""
    return texts(docs).mapInArrow(_encode(model_file(model)), "doc_id long, ids array<int>")


def decoded(own: Encoder, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The UTF-8 texts of rows of ids: the pieces' bytes without the sign that begins the first. Rows with other ids than
    of pieces and bytes, or whose bytes are no UTF-8, are the library's."""
    plain = own.by_table and len(ids) and 0 <= ids.min() and ids.max() < len(own.sizes)
    kinds = own.kinds[ids] if plain else None
    raw = own.raw[K.runs(own.places[ids], own.sizes[ids])].tobytes() if plain else b""
    ends = np.concatenate(([0], np.cumsum(own.sizes[ids]))) if plain else None
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if plain:
            kind = kinds[a:b]
            text = raw[ends[a] : ends[b]]
            text = text[1:] if a < b and kind[0] == NORMAL and text[:1] == b" " else text
            if ((kind == NORMAL) | (kind == BYTE)).all() and (not (kind == BYTE).any() or _is_text(text)):
                out.append(text)
                continue
        out.append(own.library.decode(ids[a:b].tolist()).encode())
    return out


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


#: Ids that are decoded at once, or those of one longer row.
IDS = 1 << 18


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            if ids.flatten().null_count:
                ids = pa.array([[x for x in row or [] if x is not None] for row in ids.to_pylist()], ids.type)
            cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            flat, i = ids.flatten().to_numpy(zero_copy_only=False), 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + IDS, "right")) - 1)
                texts_ = decoded(encoder(path), flat[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids.slice(i, j - i), pa.array(texts_, pa.binary()).cast(pa.string())], ["doc_id", "ids", "text"])
                i = j

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the library's decode gives of the ids, by a table of the pieces' bytes where that is all
    there is to it; null ids are none, whose text is empty, and null entries no ids."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(model_file(model)), "doc_id long, ids array<int>, text string")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded and decoded again."""
    both = decode(encode(docs, model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
