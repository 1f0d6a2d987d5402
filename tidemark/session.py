"""Session settings that the operators rely on for their semantics."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC makes naive and zoned times agree. No query needs more.
SEMANTICS = {"spark.sql.session.timeZone": "UTC"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to a session that somebody else made."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "tidemark") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SEMANTICS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
