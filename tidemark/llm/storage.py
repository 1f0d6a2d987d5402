"""Shared-folder tables that cut lineage, and the table reader of the queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, a local master, as in tests, gets a
    folder of its own, and any other an error: executors could not read this machine's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Texts sent to a Python worker at once; rows are few as texts may be long. The byte bound holds where Spark knows it.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id and text of `docs`, typed, and the columns `others` alone, in small Arrow batches from here on in this session:
    lazy results are computed after their operator has returned, so the settings stay."""
    for key, value in ARROW_BATCHES.items():
        docs.sparkSession.conf.set(key, value)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)


def piece_of(text: Column, draw: Column, most: int) -> Column:
    """At most `most` characters of a text, all of a shorter one, from a place that `draw` chooses: for fits alone."""
    return F.substring(text, F.lit(1) + F.pmod(draw, F.greatest(F.length(text) - most, F.lit(0)) + 1).cast("int"), F.lit(most))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that run inside; those of before come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: What a written table was shuffled by is freed with its job instead of when the driver next collects garbage.
WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Scratch:
    """Tables of one operator run in the shared folder. A table is written once, so lost executors never force more than a
    reread; `drop` frees those that no later plan reads. What is left goes with the driver's session, as lazy results may
    read it until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        self.count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        with settings(self.spark, WRITTEN):
            df.write.mode("overwrite").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._tidemark_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._tidemark_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Free all tables of this run: no later plan may read them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(`docs` with the file and the place in it of each row, the names of these two columns). The pair is unique and never
    null, whatever the ids, and the same whenever the files are read. Rows that come from no scan of files are written to
    the shared folder first."""
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"])
    except AnalysisException:
        docs = Scratch(docs.sparkSession, "rows").save(docs)
        meta = docs.metadataColumn("_metadata")
    names = [free_name(docs, "row_file"), free_name(docs, "row_place")]
    return docs.select("*", meta["file_path"].alias(names[0]), meta["row_index"].alias(names[1])), names


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
