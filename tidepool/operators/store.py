"""Reads of the multi-version table kv (key binary, version long, value binary; null: cleared)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import contains


class VersionError(ValueError):
    """A read version outside the retained window."""


def latest(kv: DataFrame, version: int | Column | None = None, keep_cleared: bool = False) -> DataFrame:
    """key, version, value: the newest entry of each key at or below version; cleared keys only on request."""
    at = kv if version is None else kv.where(F.col("version") <= version)
    newest = at.groupBy("key").agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))
    return newest if keep_cleared else newest.where(F.col("value").isNotNull())


def kv_at(kv: DataFrame, version: int, oldest: int | None = None, newest: int | None = None) -> DataFrame:
    """latest() at a version that must lie in the retained window."""
    if newest is not None and version > newest:
        raise VersionError("version_too_new")
    if oldest is not None and version < oldest:
        raise VersionError("version_too_old")
    return latest(kv, version)


def get(rows: DataFrame, key: bytes) -> DataFrame:
    """The row of one key: an equality that parquet scans can use."""
    return rows.where(F.col("key") == F.lit(bytearray(key)))


def get_range(rows: DataFrame, start: bytes, end: bytes, limit: int | None = None) -> DataFrame:
    """Rows with start <= key < end in key order; a limit becomes a top-k."""
    found = rows.where(contains(F.col("key"), start, end)).orderBy("key")
    return found if limit is None else found.limit(limit)


def page(rows: DataFrame, start: bytes, end: bytes, limit: int) -> DataFrame:
    """get_range with has_more on every row: whether the range goes on after the page."""
    some = get_range(rows, start, end, limit + 1)
    order = Window.orderBy("key")  # limit + 1 rows
    numbered = some.withColumn("n", F.row_number().over(order)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy()))
    return numbered.where(F.col("n") <= limit).select(*rows.columns, (F.col("all") > limit).alias("has_more"))


def multi_get(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe (key, ...) with the value of its key, null if there is none."""
    return probes.join(rows.select("key", F.col("value").alias("found")), "key", "left")


def history(kv: DataFrame, start: int, end: int) -> DataFrame:
    """Entries with start < version <= end, each with the value before it."""
    order = Window.partitionBy("key").orderBy("version")
    return kv.withColumn("before", F.lag("value").over(order)).where((F.col("version") > start) & (F.col("version") <= end))


def retain(kv: DataFrame, oldest: int) -> DataFrame:
    """What is left once history below `oldest` goes: newer entries, and each key's entry then in force unless cleared."""
    base = latest(kv, oldest).select("key", "version", "value")
    return kv.where(F.col("version") > oldest).select("key", "version", "value").unionByName(base)


def drop_from(kv: DataFrame, version: int) -> DataFrame:
    """Without the entries at or above version."""
    return kv.where(F.col("version") < version)
