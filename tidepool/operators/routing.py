"""Keys and ranges to shards, shards to logs, and slices of a log.

A shard map has a row for each shard: tag, end (exclusive, increasing); starts are the ends before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranges import covering, overlap_join

#: Shards that a lookup may write out as one expression; beyond them it is a join.
FEW = 64
#: Fixed value: 2^64 over the golden ratio.
GOLDEN = 0x9E3779B97F4A7C15


def with_starts(shards: DataFrame, first) -> DataFrame:
    """tag, start, end; shard maps are small."""
    return shards.select("tag", F.coalesce(F.lag("end").over(Window.orderBy("end")), first if isinstance(first, Column) else _literal(first)).alias("start"), "end")


def _literal(x):
    return F.lit(bytearray(x)) if isinstance(x, (bytes, bytearray)) else F.lit(x)


def lookup(rows: DataFrame, key: str, shards: list[tuple]) -> DataFrame:
    """rows with tag: the shard of the smallest end above the key; null beyond the last. shards: (tag, end), integer or binary.

    A choice of FEW ends is made by halving, so a row compares with the logarithm of their number; more shards are a table.
    """
    if len(shards) > FEW:
        spark, binary = rows.sparkSession, isinstance(shards[0][1], (bytes, bytearray))
        ends = spark.createDataFrame([(t, bytearray(e) if binary else e) for t, e in shards], f"tag int, end {'binary' if binary else 'long'}")
        last = _literal(max(e for _, e in shards))
        found = lookup_in(rows.where(F.col(key) < last), key, with_starts(ends, _literal(b"") if binary else F.lit(-(2**62))))
        return found.unionByName(rows.where(F.col(key) >= last).withColumn("tag", F.lit(None).cast("int")))
    ordered = sorted(shards, key=lambda x: x[1])

    def choose(part: list[tuple]) -> Column:
        if not part:
            return F.lit(None).cast("int")
        mid = len(part) // 2
        if len(part) == 1:
            return F.when(F.col(key) < _literal(part[0][1]), F.lit(part[0][0]))
        return F.when(F.col(key) < _literal(part[mid - 1][1]), choose(part[:mid])).otherwise(choose(part[mid:]))

    return rows.withColumn("tag", choose(ordered))


def lookup_in(rows: DataFrame, key: str, shards: DataFrame) -> DataFrame:
    """rows with tag, from a shard map (tag, start, end) of any size; rows beyond every shard are left out."""
    return covering(rows, shards.withColumnRenamed("start", "__start").withColumnRenamed("end", "__end"), key, s="__start", e="__end").drop("__start", "__end")


def clamp(ranges: DataFrame, shards: DataFrame) -> DataFrame:
    """ranges (..., s, e) cut at shard bounds: a row for each shard it meets, with tag and the part inside."""
    met = overlap_join(ranges, shards, [], ("s", "e"), ("start", "end"))
    return met.withColumn("s", F.greatest("s", "start")).withColumn("e", F.least("e", "end")).drop("start", "end")


def log_indices(tag: int, logs: int, copies: int) -> list[int]:
    """The logs that hold a shard: golden-ratio steps from its tag, taken ones skipped, last pick first."""
    picked: list[int] = []
    at = tag % logs
    for _ in range(copies):
        while at in picked:
            at = (at + 1) % logs
        picked.insert(0, at)
        at = (at + GOLDEN) % logs
    return picked


def replicas(tags: DataFrame, logs: int, copies: int) -> DataFrame:
    """tag, logs of each row, as array expressions."""
    step = GOLDEN % logs

    def pick(state: Column, _: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(0), F.lit(logs - 1)), lambda i: (state["at"] + i) % logs), lambda x: ~F.array_contains(state["got"], x))
        one = free[0]
        return F.struct(((one + step) % logs).cast("int").alias("at"), F.concat(F.array(one), state["got"]).alias("got"))

    start = F.struct((F.col("tag") % logs).cast("int").alias("at"), F.array().cast("array<int>").alias("got"))
    return tags.withColumn("logs", F.aggregate(F.sequence(F.lit(1), F.lit(copies)), start, pick)["got"])


def slice_index(log: DataFrame) -> DataFrame:
    """version, tag, n, first: the runs of a version's mutations once sorted by tag (stable in txn, seq)."""
    counts = log.groupBy("version", "tag").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("version").orderBy("tag").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("first", F.coalesce(before, F.lit(0)).cast("long"))


def touched(log: DataFrame) -> DataFrame:
    """version, tags: the shards that a version writes."""
    return log.groupBy("version").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def pruned(log: DataFrame, start: int, end: int, shards: list[tuple[int, int]]) -> DataFrame:
    """log (k, tag, ...) restricted to keys in [start, end), with the tags that can hold them as a partition filter."""
    tags, low = [], None
    for tag, stop in sorted(shards, key=lambda x: x[1]):
        if (low is None or low < end) and start < stop:
            tags.append(tag)
        low = stop
    return log.where(F.col("tag").isin(tags) & (F.col("k") >= start) & (F.col("k") < end))
