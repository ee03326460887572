"""Chunks of a shard's transactions in a blob store: a writer that flushes by size and age, and a reader by version.

A chunk lies at c/<shard>/<name>, where the name is the inverted newest version of its transactions, so listing a shard gives
the newest chunk first. Chunks are packed by tasks, a chunk at a time; the driver only hands the bytes on, one chunk in hand.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.batching import CHUNK_BYTES, CHUNK_GAP, batches
from .files import chunk_header, load, write_chunk
from .objects import Objects
from .snapshots import name_of, version_of

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def shard_name(tag: int) -> str:
    out = _DIGITS[tag % 36]
    while tag := tag // 36:
        out = _DIGITS[tag % 36] + out
    return out


def packed(log: DataFrame, bytes_: int = CHUNK_BYTES, gap: int = CHUNK_GAP) -> DataFrame:
    """path, content of the chunks of transactions (tag int, version long, payload binary)."""
    rows = log.select("tag", "version", "payload", F.octet_length("payload").cast("long").alias("size"))

    def pack(parts):
        last, held = None, []

        def chunk() -> pa.RecordBatch:
            path = f"c/{shard_name(last[0])}/{name_of(held[-1][0])}"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([write_chunk(held)], pa.binary())], ["path", "content"])

        for part in parts:
            for tag, version, payload, batch in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if held and (tag, batch) != last:
                    yield chunk()
                    held = []
                last = (tag, batch)
                held.append((version, payload))
        if held:
            yield chunk()

    return batches(rows, "tag", "version", "size", bytes_=bytes_, gap=gap).mapInArrow(pack, "path string, content binary")


class Chunks:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Objects(spark, root)

    def write(self, log: DataFrame, bytes_: int = CHUNK_BYTES, gap: int = CHUNK_GAP) -> int:
        """Writes the chunks of transactions, each once; how many are new."""
        rows = packed(log, bytes_, gap).toLocalIterator()
        return sum(self.store.put_if_not_exists(r["path"], bytes(r["content"])) for r in rows)

    def paths(self, tag: int) -> list[str]:
        """Newest first."""
        return self.store.list(f"c/{shard_name(tag)}/")

    def newest(self, path: str) -> int:
        return version_of(path.rpartition("/")[2])

    def metadata(self, tag: int) -> DataFrame:
        """path, min_version, max_version, n of a shard's chunks."""
        found = [(p, chunk_header(self.store.get(p))) for p in self.paths(tag)]
        return self.spark.createDataFrame([(p, h["min_version"], h["max_version"], h["n"]) for p, h in found], "path string, min_version long, max_version long, n long")

    def find(self, tag: int, version: int) -> str | None:
        """The chunk whose versions reach over `version`: the oldest one that is not all older, if it starts in time."""
        later = [p for p in self.paths(tag) if self.newest(p) >= version]
        return later[-1] if later and chunk_header(self.store.get(later[-1]))["min_version"] <= version else None

    def read_from(self, tag: int, version: int = 0) -> DataFrame:
        """path, version, payload, error of a shard's transactions at or above version; older chunks are not opened."""
        paths = [f"{self.root}/{p}" for p in self.paths(tag) if self.newest(p) >= version]
        if not paths:
            return self.spark.createDataFrame([], "path string, version long, payload binary, error string")
        return load(self.spark, paths, "chunk", version)

    def latest_version(self, tag: int) -> int | None:
        paths = self.paths(tag)
        return self.newest(paths[0]) if paths else None

    def oldest_version(self, tag: int) -> int | None:
        paths = self.paths(tag)
        return chunk_header(self.store.get(paths[-1]))["min_version"] if paths else None
