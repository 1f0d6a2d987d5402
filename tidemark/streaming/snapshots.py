"""Snapshots of a stream's state: read from its state store, kept by version, and the start of the next run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def states(spark: SparkSession, run: str, name: str, batch: int | None = None) -> DataFrame:
    """The key's and the value's columns of the state variable `name` of a run (a folder of `pipeline.drain`), after its last
    batch or after `batch`. The store is read by tasks, a partition each; the run needn't have ended."""
    reader = spark.read.format("statestore").option("path", f"{run}/checkpoint").option("stateVarName", name)
    return (reader if batch is None else reader.option("batchId", batch)).load().select("key.*", "value.*")


def batches(spark: SparkSession, run: str) -> tuple[int, int]:
    """The first and the last batch whose state a run still holds."""
    r = spark.read.format("state-metadata").load(f"{run}/checkpoint").agg(F.min("minBatchId"), F.max("maxBatchId")).first()
    return r[0], r[1]


def keep(spark: SparkSession, run: str, name: str, to: str) -> int:
    """Writes the state after a run's last batch as a version of the table in `to`, and gives its number, one more than the
    versions there. A version that is there is never touched."""
    version = 1 + max(versions(spark, to), default=0)
    states(spark, run, name).write.mode("error").parquet(f"{to}/version={version}")
    return version


def versions(spark: SparkSession, at: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(int(f.getPath().getName().removeprefix("version=")) for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def kept(spark: SparkSession, at: str, version: int | None = None) -> DataFrame:
    """A version of a kept state, by default the latest that was written whole; fit as `initial` of a stream of its kind."""
    return spark.read.parquet(f"{at}/version={version or versions(spark, at)[-1]}")
