"""Dumps and statistics of a keyspace."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import contains, strinc


def dump(rows: DataFrame, prefix: bytes = b"", limit: int | None = None, drop_empty: bool = True) -> DataFrame:
    """key and value as upper-case hex in key order, of keys with the prefix."""
    if prefix:
        rows = rows.where(contains(F.col("key"), prefix, strinc(prefix)))
    if drop_empty:
        rows = rows.where("value is not null and octet_length(value) > 0")
    out = rows.orderBy("key")
    out = out if limit is None else out.limit(limit)
    return out.select(F.hex("key").alias("key"), F.hex("value").alias("value"))


def write_dump(dumped: DataFrame, path: str, kind: str) -> None:
    """kind: csv or json (a row a line)."""
    if kind not in ("csv", "json"):
        raise ValueError("dumps are csv or json")
    writer = dumped.write.mode("error")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def page_statistics(rows: DataFrame, page: str) -> DataFrame:
    """pages, keys, and the smallest, mean, median and largest number of keys on a page."""
    per = rows.groupBy(page).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("keys"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.max("n").alias("most")
    )


def key_statistics(rows: DataFrame, key: str) -> DataFrame:
    """keys, first_key, last_key."""
    return rows.agg(F.count(F.lit(1)).alias("keys"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def histogram(rows: DataFrame, page: str, width: int) -> DataFrame:
    """bucket (keys on a page, rounded down to width) and pages in it."""
    per = rows.groupBy(page).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy((F.floor(F.col("n") / width) * width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("pages"))


def durability_profile(config: dict) -> list[str]:
    """What keeps a configuration (replicas, logs, paths) from being durable; empty if nothing does."""
    found = []
    if config.get("replicas", 0) < 3:
        found.append("fewer than 3 replicas")
    if config.get("logs", 0) < 3:
        found.append("fewer than 3 logs")
    found += [f"no persistent path for {k}" for k, v in sorted(config.get("paths", {}).items()) if not v]
    return found
