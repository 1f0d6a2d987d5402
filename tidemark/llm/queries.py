"""The queries of this subpackage: each runs one operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bm25_search, decontaminate, language_id, minhash_dedup, packing, periodic_runs, pieces, resharding, secret_scan, token_counts, toxicity, url_filter, whitening,
)
from tidemark.llm.storage import table


#: Shards of the layout that op3 starts from; its rows lie there by their source.
OLD_SHARDS = 16
#: op10 takes the documents whose id it divides as queries.
QUERY_EVERY = 20


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the rules and what its aliases are; null urls are allowed, as `url_filter.judge` says of all odd rows."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through flat token files; null and empty texts count 0 and rows without an id are rows as any others."""
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document from 16 old shards, by its source, into 24 even ones; the affected ones are written and read again.
    Null texts weigh 8 bytes, null sources lie in one shard, and null or repeated ids are rows as any others."""
    docs = table(spark, sf_dir, "documents")
    return resharding.resharded(docs, F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of power-of-two lengths; null and empty texts are the end token alone, ids may be null or repeated."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a score learned from the rows that are not held out; null and empty texts score as harmless ones."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item; null texts hold none, null ids are matched too."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a language learned from the rows that are not held out; null texts and texts without a letter: und."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; a ledger that knows one rule is brought up to all of them, so that only the other pairs of blob and rule
    are scanned. Null texts are empty, null and repeated ids are rows as any others."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secrets(docs, secret_scan.update_ledger(docs, None, secret_scan.RULES[:1]))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component over two-word shingles at 0.8; null texts and texts without words are alone."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20, its whole text being the query; null texts ask and
    answer nothing."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25_search.search(docs, queries)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of words, of four periods and six words at least, after the tails that its contract repeats; null
    texts have no words, rows without an id keep their text."""
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.tailed(table(spark, sf_dir, "documents"))))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the four leading components of the distinct ones, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests; null texts are empty."""
    return pieces.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_url_filter, op2_token_counts, op3_resharding, op4_packing, op5_toxicity, op6_decontamination, op7_language_id,
        op8_secret_scan, op9_minhash_dedup, op10_bm25_search, op11_periodic_runs, op12_embedding_whitening, op13_sentencepiece,
    )
}
ORACLES = {"op1_url_filter": url_filter.ORACLE, "op8_secret_scan": secret_scan.ORACLE}
