"""A table of documents that is changed by copy on write.

Data files are never touched once written. A manifest, a numbered file, names those that make the table; a change rewrites the
files that hold changed keys, leaves all others as they are, and then writes the next manifest by a rename, which fails where
another writer was first. Until the rename the table is the old one, so whatever breaks off leaves no trace but files that
`vacuum` removes. Manifests hold a row for each file, with its least and largest key, which tell what files a change may
concern before any is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changed keys that are broadcast to the files they may lie in; beyond, they meet by a shuffled join.
BROADCAST_KEYS = 100_000


class Conflict(RuntimeError):
    """Another writer changed the table first."""


class DocumentStore:
    """The table in `path`, whose rows the unique, non-null column `key` names."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[dict]]:
        """(version, files with path, rows, least, top) of a version, by default the latest; 0 and none before the first."""
        known = self.versions()
        if not known:
            return 0, []
        version = version or known[-1]
        text = self.spark.read.text(f"{self.path}/manifests/{version:010d}.json").collect()
        return version, [json.loads(r.value) for r in text]

    def _publish(self, version: int, files: list[dict]) -> None:
        """Makes `files` the table of this version: a file written aside, then one rename to a name that must be free."""
        fs, aside = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write("\n".join(json.dumps(f) for f in files).encode())
        finally:
            out.close()
        _, to = self._fs(f"{self.path}/manifests/{version:010d}.json")
        if fs.exists(to) or not fs.rename(aside, to):
            fs.delete(aside, False)
            raise Conflict(f"version {version} is there already")

    def _written(self, rows: DataFrame, files: int | None = None, by: str | None = None) -> list[dict]:
        """Writes rows as new files, sorted ranges of the key or the values of the column `by` apart, and describes them."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        if by is not None:
            dealt = rows.repartition(by).drop(by)
        else:
            dealt = rows.repartitionByRange(files, self.key) if files else rows.repartitionByRange(self.key)
        dealt.sortWithinPartitions(self.key).write.parquet(folder)
        made = self.spark.read.parquet(folder)
        own = made.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), F.min(self.key).alias("least"), F.max(self.key).alias("top"))
        return [r.asDict() for r in own.orderBy("least").collect()]

    # the table

    def read(self, version: int | None = None) -> DataFrame:
        _, files = self.manifest(version)
        if not files:
            raise ValueError(f"{self.path} holds no table")
        return self.spark.read.parquet(*[f["path"] for f in files])

    def append(self, rows: DataFrame, files: int | None = None) -> int:
        """Adds rows, whose keys must be new, and gives the new version."""
        version, before = self.manifest()
        self._publish(version + 1, before + self._written(rows, files))
        return version + 1

    def affected(self, changes: DataFrame, files: list[dict]) -> list[str]:
        """The files that hold a key of `changes`: by their ranges at first, then by a scan of the keys of those alone."""
        ends = changes.agg(F.min(self.key).alias("least"), F.max(self.key).alias("top")).first()
        if ends.least is None:
            return []
        near = [f["path"] for f in files if f["rows"] and f["least"] <= ends.top and ends.least <= f["top"]]
        if not near:
            return []
        keys = changes.select(self.key).distinct()
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        held = self.spark.read.parquet(*near).select(self.key, F.col("_metadata.file_path").alias("__file"))
        return [r[0] for r in held.join(F.broadcast(keys) if few else keys, self.key, "left_semi").select("__file").distinct().collect()]

    def update(self, changes: DataFrame, sets: dict[str, Column]) -> tuple[int, int]:
        """Sets columns of the rows whose key `changes` (one row a key) holds: `sets` names columns and their new values, made
        of the table's columns and, as change.<name>, those of `changes`. Keys that the table doesn't hold change
        nothing. Gives (version, files rewritten)."""
        version, files = self.manifest()
        hit = set(self.affected(changes, files))
        if not hit:
            return version, 0
        rows = self.spark.read.parquet(*sorted(hit)).withColumn("__file", F.col("_metadata.file_path"))
        own = changes.select(F.col(self.key).alias("__key"), F.struct(*[c for c in changes.columns]).alias("change"))
        few = own.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        met = rows.join(F.broadcast(own) if few else own, F.col(self.key) == F.col("__key"), "left")
        columns = [c for c in rows.columns if c != "__file"]
        new = met.select(*[F.when(F.col("__key").isNotNull(), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in columns], "__file")
        made = self._written(new.select(*columns, "__file"), by="__file")
        kept = [f for f in files if f["path"] not in hit]
        self._publish(version + 1, sorted(kept + made, key=lambda f: f["least"]))
        return version + 1, len(hit)

    def vacuum(self) -> int:
        """Removes data files that no manifest names, as broken-off changes leave them; gives how many. Not beside writers."""
        named = {f["path"].rpartition("/data/")[2] for v in self.versions() for f in self.manifest(v)[1]}
        fs, at = self._fs(f"{self.path}/data")
        gone, found = 0, fs.listFiles(at, True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet") and path.toString().rpartition("/data/")[2] not in named:
                gone += bool(fs.delete(path, False))
        return gone
