"""Token counts by a separator scan over flat, unindexed token files (operator 2).

A flat file is a stream of token ids in which an end-of-document id follows each document, stored in blocks that know
nothing of documents. Each block is searched alone and vectorised; a document that spans blocks is stitched together by a
prefix scan over one summary row for each block: tokens so far and the place of the last separator. The scan has two
levels, chunks of blocks and blocks in a chunk, so no task takes the summaries of a whole large file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens as T
from tidemark.llm import textkernel as K
from tidemark.llm.storage import Scratch, texts

#: Of the public 50k vocabulary.
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 19
#: Blocks in a chunk of the prefix scan.
CHUNK = 256

BLOCK_SCHEMA = "file long, block long, payload binary, doc_ids array<long>"
SCAN_SCHEMA = "file long, block long, n_tokens long, separators array<int>, doc_ids array<long>"


def _flatten(path: str, block_tokens: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block = TaskContext.get().partitionId(), 0
        held, count = [], 0
        ids: list[int | None] = []

        def out(stream: np.ndarray) -> pa.RecordBatch:
            nonlocal ids
            if len(stream) and int(stream.max()) > 0xFFFF:
                raise ValueError("the vocabulary has ids beyond 16 bits")
            ended = int((stream == end_id).sum())
            mine, ids = ids[:ended], ids[ended:]
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([stream.astype("<u2").tobytes()], pa.binary()), pa.array([mine], pa.list_(pa.int64()))], ["file", "block", "payload", "doc_ids"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, data, offsets in K.slices(batch.column(1), 1 << 20):
                tokens, cuts = T.encoder(path).encode(data, offsets)
                held.append(np.insert(tokens, cuts[1:], end_id))
                ids += names[first:last]
                count += len(held[-1])
                while count >= block_tokens:
                    stream = np.concatenate(held)
                    yield out(stream[:block_tokens])
                    block += 1
                    held, count = [stream[block_tokens:]], count - block_tokens
        if count:
            yield out(np.concatenate(held))

    return run


def flat_blocks(docs: DataFrame, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, block, payload, doc_ids): a flat token file of little-endian 16-bit ids for each partition of `docs`, in
    blocks of `block_tokens` ids, the last one shorter. doc_ids is the manifest of the documents that end in a block; the
    scan carries it along and doesn't use it to find them. Null and empty texts are a separator alone."""
    docs = texts(docs)
    return docs.mapInArrow(_flatten(T.vocabulary(tokenizer), block_tokens, end_id), BLOCK_SCHEMA)


def _search(end_id: int, width: int):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                payload = batch.column(2)[k].as_buffer()
                ids = np.frombuffer(payload, kind, len(payload) // width if payload is not None else 0) if payload is not None else np.empty(0, kind)
                found = np.flatnonzero(ids == end_id).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([len(ids)], pa.int64()), lists, batch.column(3).slice(k, 1)], ["file", "block", "n_tokens", "separators", "doc_ids"])

    return run


def separator_scan(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """(file, ordinal, doc_id, start, n_tokens) of each document in flat token files, from their blocks (file, block,
    payload and, if there is a manifest, doc_ids). start: the tokens of the file before the document; n_tokens: without
    its separator; ordinal: its place in the file from 0.

    Two separators in a row: a document of no tokens. What follows the last separator of a file is no document. Null and
    empty payloads have no tokens. Blocks may be missing in the numbering and come in any order; file and block must be
    unique. An empty table gives an empty result.
    """
    spark = blocks.sparkSession
    scratch = Scratch(spark, "separators")
    manifest = F.col("doc_ids").cast("array<long>") if "doc_ids" in blocks.columns else F.lit(None).cast("array<long>")
    read = blocks.select(F.col("file").cast("long").alias("file"), F.col("block").cast("long").alias("block"), F.col("payload").cast("binary").alias("payload"), manifest.alias("doc_ids"))
    scanned = scratch.save(read.mapInArrow(_search(end_id, width), SCAN_SCHEMA))
    summary = scanned.select("file", "block", F.floor(F.col("block") / CHUNK).alias("chunk"), "n_tokens", F.size("separators").cast("long").alias("n_docs"), F.try_element_at("separators", F.lit(-1)).cast("long").alias("last"))
    in_chunk = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = summary.select("*", F.coalesce(F.sum("n_tokens").over(in_chunk), F.lit(0)).alias("base"), F.coalesce(F.sum("n_docs").over(in_chunk), F.lit(0)).alias("docs_before"))
    inner = inner.withColumn("end", F.col("base") + F.col("last")).withColumn("open_from", F.max("end").over(in_chunk))
    chunks = inner.groupBy("file", "chunk").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_docs").alias("docs"), F.max("end").alias("chunk_end"))
    over = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    outer = chunks.select("file", "chunk", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("chunk_base"), F.coalesce(F.sum("docs").over(over), F.lit(0)).alias("chunk_docs"), "chunk_end")
    outer = outer.select("file", "chunk", "chunk_base", "chunk_docs", F.max(F.col("chunk_base") + F.col("chunk_end")).over(over).alias("chunk_open"))
    placed = inner.join(outer, ["file", "chunk"]).select(
        "file", "block",
        (F.col("chunk_base") + F.col("base")).alias("base"), (F.col("chunk_docs") + F.col("docs_before")).alias("first"),
        (F.coalesce(F.col("chunk_base") + F.col("open_from"), F.col("chunk_open"), F.lit(-1)) + 1).alias("opened"),
    )
    ends = scanned.where(F.size("separators") > 0).join(placed, ["file", "block"])
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice("separators", F.lit(1), F.size("separators") - 1))
    zipped = F.arrays_zip(F.coalesce("doc_ids", F.array().cast("array<long>")).alias("doc_id"), F.col("separators").alias("at"), before.alias("before"))
    pieces = ends.select("file", "base", "first", "opened", F.posexplode(zipped).alias("k", "piece"))
    start = F.coalesce(F.col("base") + F.col("piece.before") + 1, "opened")
    return pieces.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "piece.doc_id", start.alias("start"), (F.col("base") + F.col("piece.at") - start).alias("n_tokens"))


def document_token_counts(docs: DataFrame, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, doc_id, start, n_tokens), a row for each row of `docs`, through flat token files, which are written to
    the shared folder, and the separator scan of what is read there.

    Null and empty texts have no tokens; rows with null or repeated doc_id are documents of their own; other columns aren't
    read; texts may be of any length. An empty table gives an empty result. A vocabulary with ids beyond 16 bits is an error.
    """
    stored = Scratch(docs.sparkSession, "flat").save(flat_blocks(docs, tokenizer, block_tokens))
    return separator_scan(stored)
