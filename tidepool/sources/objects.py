"""A blob store over any Hadoop file system: put, get, delete, list and conditional puts.

put_if_not_exists rests on the file system's exclusive create; put_if_version compares a content hash and
needs one writer a key, as object stores without conditional writes do.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


class Objects:
    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self.root, self._jvm = root.rstrip("/"), sc._jvm
        self._fs = self._path("").getFileSystem(sc._jsc.hadoopConfiguration())

    def _path(self, key: str):
        if ".." in key.split("/"):
            raise ValueError("keys stay below the root")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def _write(self, key: str, data: bytes, overwrite: bool) -> None:
        out = self._fs.create(self._path(key), overwrite)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def put(self, key: str, data: bytes) -> None:
        self._write(key, data, True)

    def get(self, key: str) -> bytes | None:
        p = self._path(key)
        if not self._fs.exists(p):
            return None
        f = self._fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(f))
        finally:
            f.close()

    def delete(self, key: str) -> bool:
        return self._fs.delete(self._path(key), False)

    def list(self, prefix: str = "") -> list[str]:
        """Keys that start with prefix, sorted."""
        if not self._fs.exists(self._path("")):
            return []
        files, out = self._fs.listFiles(self._path(""), True), []
        top = self._fs.resolvePath(self._path("")).toUri().getPath().rstrip("/")
        while files.hasNext():
            key = files.next().getPath().toUri().getPath()[len(top) + 1 :]
            if key.startswith(prefix) and not key.rpartition("/")[2].startswith("."):
                out.append(key)
        return sorted(out)

    def put_if_not_exists(self, key: str, data: bytes) -> bool:
        if self._fs.exists(self._path(key)):
            return False
        self._write(key, data, False)
        return True

    def get_with_version(self, key: str) -> tuple[bytes, str] | None:
        data = self.get(key)
        return None if data is None else (data, hashlib.sha256(data).hexdigest())

    def put_if_version(self, key: str, data: bytes, version: str) -> bool:
        now = self.get_with_version(key)
        if now is None or now[1] != version:
            return False
        self.put(key, data)
        return True
