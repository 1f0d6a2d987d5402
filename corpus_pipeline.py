"""A training-corpus pipeline: reject toxic texts, keep one of each group of near copies, drop documents that hold test
items, mask secrets, and pack what is left into sequences of power-of-two lengths.

Each stage takes (spark, docs, sf_dir); run() writes each stage's rows as Parquet in the shared folder and reads them
again for the next one, so a lost executor costs a stage's tasks and never an earlier stage.

Every stage judges rows one by one, by their whole text and their place in the files, never by doc_id: rows with null or
repeated ids, and rows that are equal, are rows as any others. Null and empty texts are harmless, near no other text, hold no
test item and no secret, and are packed as an end token alone. Texts may be of any length, columns beyond those of documents
stay until the last stage whatever their names, and an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, minhash_dedup, packing, secret_scan, toxicity
from tidemark.llm.storage import Scratch, table

#: Near copies of whole documents: five-word shingles at a similarity of 0.8 or more.
DEDUP = minhash_dedup.DedupConfig(words=5, percent=80)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text's toxicity score reaches the threshold go; null and empty texts stay. Learns from the labelled rows of
    this input; without rows of both labels nothing goes."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that with the smallest id, of equal or missing ids the first by its place. Null
    and empty texts, and texts without words, are linked with nothing and stay."""
    return minhash_dedup.drop_near_duplicates(docs, DEDUP)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item, copied or edited, go; null texts hold none, and null items and items without an
    id are in no text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are masked, and n_chars follows. Null texts stay null."""
    return secret_scan.mask_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each sequence, with its token ids; null and empty texts are a sequence of one end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_test_items),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Classification, sketching, alignment and tokenisation are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
