"""Files by path: folders that name labels, stamps in file names, and lists of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Year to second at the beginning of a file's name.
STAMP = r"(\d{8}_\d{6})[^/]*$"


def labelled_files(spark: SparkSession, root: str, suffix: str = ".jpg") -> DataFrame:
    """(path, label, taken_at, size) of each file below `root` whose name ends so: label is its folder, taken_at the stamp
    that its name begins with, null without a valid one. Contents are not read until they are asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select("path", F.url_decode(folder).alias("label"), stamp(F.col("path")).alias("taken_at"), F.col("length").alias("size"))


def stamp(path: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(path, "/?" + STAMP, 1), F.lit("yyyyMMdd_HHmmss"))


def check_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, tolerance) of a JSON list of checks; a check without a type is exact, one without a name no check."""
    read = spark.read.option("multiLine", True).schema("name string, type string, tol double").json(path)
    return read.where("name IS NOT NULL").select("name", F.coalesce("type", F.lit("exact")).alias("kind"), F.col("tol").alias("tolerance"))
