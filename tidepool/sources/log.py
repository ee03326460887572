"""The transaction log as a table: version, txn, seq, tag, k, op, operand; and its chunks.

Order is in the columns, so appends need no queue and reads no single writer.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Transactions a pull returns by default and at most, and the largest transaction in bytes.
PULL_DEFAULT, PULL_MOST, MAX_TRANSACTION = 100, 500, 10_000_000


class LogError(ValueError):
    pass


def decided(pushes: DataFrame, last: int) -> DataFrame:
    """pushes (expected, version, bytes, arrival) with state: what a log whose last version is `last` does with each.

    accepted: it follows the log, directly or through other pushes here; waiting: a predecessor is missing;
    tx_out_of_order: it expects a version before the last, or one that an earlier arrival expects as well, or does not come after it;
    tx_too_large: over MAX_TRANSACTION bytes. The pushes that follow form one chain, so they are those before the
    first one whose predecessor nobody pushed: a join and a minimum, in no order.
    """
    large, old = F.col("bytes") > MAX_TRANSACTION, (F.col("expected") < last) | (F.col("version") <= F.col("expected"))
    first = pushes.where(~large & ~old).groupBy("expected").agg(F.min(F.struct("arrival", "version")).alias("x")).select("expected", "x.*")
    orphans = first.where(F.col("expected") != last).join(first.select(F.col("version").alias("expected")), "expected", "left_anti")
    known = pushes.join(first.select("expected", F.col("arrival").alias("first_arrival")), "expected", "left")
    known = known.withColumn("gap", orphans.agg(F.min("expected").alias("gap")).scalar())
    state = (
        F.when(large, "tx_too_large").when(old | (F.col("arrival") != F.col("first_arrival")), "tx_out_of_order")
        .when(F.col("gap").isNull() | (F.col("expected") < F.col("gap")), "accepted").otherwise("waiting")
    )
    return known.withColumn("state", state).drop("first_arrival", "gap")


def push(log: DataFrame, pushes: DataFrame, path: str, last: int) -> DataFrame:
    """Appends the mutations (version, ...) of the accepted pushes below path; the decisions."""
    found = decided(pushes, last)
    append(log.join(found.where("state = 'accepted'").select("version"), "version", "left_semi"), path)
    return found


def append(log: DataFrame, path: str) -> None:
    """Writes rows in version order within files, a folder for each shard, so that scans prune both ways."""
    log.repartition("tag").sortWithinPartitions("tag", "version").write.mode("append").partitionBy("tag").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pull(log: DataFrame, after: int, limit: int = PULL_DEFAULT, until: int | None = None, oldest: int | None = None) -> DataFrame:
    """The mutations of the first `limit` transactions with a version strictly above `after`, `until` at most, in order."""
    if oldest is not None and after < oldest:
        raise LogError("version_too_old")
    if until is not None and until < after:
        raise LogError("invalid_last_version")
    rows = log.where(F.col("version") > after)
    if until is not None:
        rows = rows.where(F.col("version") <= until)
    some = rows.select("version").distinct().orderBy("version").limit(min(limit, PULL_MOST))
    return rows.join(F.broadcast(some), "version", "left_semi").orderBy("version", "txn", "seq")


def shard_pull(buffer: DataFrame, stored: DataFrame, tag: int, start: int, limit: int = PULL_DEFAULT) -> DataFrame:
    """A shard's mutations of the first `limit` versions at or above start: of the buffer if it has any, else of what is stored."""
    here, there = (df.where((F.col("tag") == tag) & (F.col("version") >= start)) for df in (buffer, stored))
    both = here.withColumn("source", F.lit(0)).unionByName(there.withColumn("source", F.lit(1)))
    both = both.withColumn("buffered", here.agg(F.count(F.lit(1)).alias("n")).scalar())
    rows = both.where((F.col("source") == 0) == (F.col("buffered") > 0)).drop("source", "buffered")
    some = rows.select("version").distinct().orderBy("version").limit(limit)
    return rows.join(F.broadcast(some), "version", "left_semi")


def read_from(log: DataFrame, version: int) -> DataFrame:
    """Rows at or above version."""
    return log.where(F.col("version") >= version)


def in_order(log: DataFrame, push: str | None = None) -> DataFrame:
    """The log with every transaction once and whole, although some were pushed again.

    push: the column that numbers pushes; a later push of a version that is already there is refused. Without it,
    repeated rows of one (version, txn, seq) are one.
    """
    if push is None:
        return log.dropDuplicates(["version", "txn", "seq"])
    first = log.groupBy("version").agg(F.min(push).alias("__first"))
    return log.join(first, "version").where(F.col(push) == F.col("__first")).drop("__first")


def chunks(log: DataFrame, size: int) -> DataFrame:
    """tag, chunk, min_version, max_version, n: the directory of chunks of `size` versions."""
    return log.groupBy("tag", F.floor(F.col("version") / size).alias("chunk")).agg(
        F.min("version").alias("min_version"), F.max("version").alias("max_version"), F.count(F.lit(1)).alias("n")
    )


def chunk_for(directory: DataFrame, version: int) -> DataFrame:
    """The chunks that can hold a version."""
    return directory.where((F.col("min_version") <= version) & (F.col("max_version") >= version))


def first_at_or_after(log: DataFrame, version: int) -> DataFrame:
    """tag, version: each shard's first entry at or above version."""
    return log.where(F.col("version") >= version).groupBy("tag").agg(F.min("version").alias("version"))


def durable(log: DataFrame) -> DataFrame:
    """version: the smallest of the shards' largest versions, up to which every shard is complete."""
    return log.groupBy("tag").agg(F.max("version").alias("v")).agg(F.min("v").alias("version"))


def trimmed(log: DataFrame, durable_version: int) -> DataFrame:
    """What the log keeps once everything up to durable_version is stored elsewhere."""
    return log.where(F.col("version") > durable_version)


def _size(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2 * width, "0"))


def mutation_bytes(key: Column, operand: Column) -> Column:
    """A mutation as bytes: 00, key and value for a set, 01 and the key for a clear; lengths take 2 and 4 bytes."""
    head = F.concat(_size(F.octet_length(key), 2), key)
    return F.when(operand.isNull(), F.concat(F.unhex(F.lit("01")), head)).otherwise(F.concat(F.unhex(F.lit("00")), head, _size(F.octet_length(operand), 4), operand))


def section_checksum(tag: int, body: Column) -> Column:
    """CRC-32 over a section's tag, its 24-bit size and its body."""
    return F.crc32(F.concat(F.lit(bytearray([tag])), _size(F.octet_length(body), 3), body))


def checksums(log: DataFrame) -> DataFrame:
    """version, crc: of each version, the checksum of its mutations' section (tag 1), the mutations in order."""
    body = mutation_bytes(F.col("k").cast("string").cast("binary"), F.col("operand").cast("binary"))
    rows = log.select("version", F.struct("txn", "seq", body.alias("b")).alias("x"))
    whole = rows.groupBy("version").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # a transaction's, MAX_TRANSACTION bytes at most
    joined = F.unhex(F.array_join(F.transform("xs", lambda x: F.hex(x["b"])), ""))
    return whole.select("version", section_checksum(1, joined).alias("crc"))


def system_changes(log: DataFrame, seen: int) -> DataFrame:
    """Entries above version `seen` whose binary key is in the system space."""
    return log.where((F.col("version") > seen) & (F.col("key") >= F.lit(bytearray(b"\xff"))))
