"""Versioned snapshots of a keyspace, named so that the newest sorts first."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import MAX_VERSION

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def name_of(version: int) -> str:
    n, out = MAX_VERSION - version, ""
    for _ in range(13):
        n, d = divmod(n, 36)
        out = _DIGITS[d] + out
    return out


def version_of(name: str) -> int:
    return MAX_VERSION - int(name, 36)


class Snapshots:
    """Snapshots below a folder of any file system that Spark reaches; each is Parquet sorted by key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, version: int) -> str:
        return f"{self.folder}/s/{name_of(version)}"

    def write(self, version: int, state: DataFrame) -> None:
        """Writes once: a snapshot that exists is an error."""
        state.repartitionByRange("key").sortWithinPartitions("key").write.mode("error").parquet(self._at(version))

    def versions(self) -> list[int]:
        """Newest first."""
        root = self._path(f"{self.folder}/s")
        if not self._fs.exists(root):
            return []
        return [version_of(n) for n in sorted(s.getPath().getName() for s in self._fs.listStatus(root))]

    def latest_version(self) -> int | None:
        return next(iter(self.versions()), None)

    def exists(self, version: int) -> bool:
        return self._fs.exists(self._path(self._at(version)))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._at(version))

    def read_latest(self) -> DataFrame | None:
        v = self.latest_version()
        return None if v is None else self.read(v)

    def delete(self, version: int) -> bool:
        return self._fs.delete(self._path(self._at(version)), True)

    def delete_older_than(self, version: int) -> int:
        old = [v for v in self.versions() if v < version]
        for v in old:
            self.delete(v)
        return len(old)


def compacted(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value: a snapshot (key, value) with later entries (key, version, value) folded in."""
    base = snapshot.select("key", F.lit(-1).cast("long").alias("version"), "value")
    newest = base.unionByName(changes.select("key", "version", "value")).groupBy("key").agg(F.max_by("value", "version").alias("value"))
    return newest.where("value is not null")
