"""Packing by power-of-two decomposition (operator 4).

A document of n tokens, its end token among them, is cut into pieces whose lengths are the powers of two of n's binary
form, with as many pieces of the longest length as fit (2048 by default). Each piece is a sequence of its own and
sequences of one length form a bucket, so no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens as T
from tidemark.llm import textkernel as K
from tidemark.llm.storage import texts

LONGEST = 2048
END_ID = 1


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The piece lengths of n tokens, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def _cut(path: str, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column(0)
            for first, last, data, offsets in K.slices(batch.column(1), 1 << 20):
                ids, cuts = T.encoder(path).encode(data, offsets)
                rows, starts, lengths, crcs, totals, pieces = [], [], [], [], [], []
                for k in range(last - first):
                    own = np.empty(cuts[k + 1] - cuts[k] + 1, "<u4")
                    own[:-1], own[-1] = ids[cuts[k] : cuts[k + 1]], END_ID
                    raw = memoryview(own.tobytes())
                    at = 0
                    for size in binary_lengths(len(own), longest):
                        rows.append(first + k)
                        starts.append(at)
                        lengths.append(size)
                        crcs.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        totals.append(len(own))
                        if with_ids:
                            pieces.append(own[at : at + size])
                        at += size
                size = np.array(lengths, np.int64)
                columns = [
                    doc_ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(size), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()),
                    pa.array(sequence + np.arange(len(size), dtype=np.int64)), pa.array(np.zeros(len(size), np.int64)), pa.array(np.log2(size).astype(np.int32)),
                ]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if with_ids:
                    flat = np.concatenate(pieces).astype(np.int32) if pieces else np.empty(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat)))
                    names.append("ids")
                sequence += len(size)
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """A row for each sequence: doc_id, start (its document's tokens before it), length (a power of two), ids_crc32,
    doc_tokens, sequence_id, offset (0: one piece fills a sequence), bucket (log2 of the length) and, with_ids, ids.

    Null and empty texts are a document of the end token alone. Rows with null or repeated doc_id are documents of their
    own each. Texts may be of any length. An empty table has no sequence. sequence_id is the task's number and the
    piece's place in it, so a task that is run again gives the same ids as long as `docs` is a scan or a written table.
    No shuffle: writers partition by bucket.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    docs = texts(docs)
    return docs.mapInArrow(_cut(T.vocabulary(tokenizer), longest, with_ids), SCHEMA + ", ids array<int>" * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
