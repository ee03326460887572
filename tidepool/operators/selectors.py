"""Key selectors: the key so many ranks from a place in key order, for many selectors at once.

The documented contract: first_greater_or_equal(k) is the smallest key >= k, first_greater_than(k) the
smallest > k, last_less_or_equal(k) the largest <= k, last_less_than(k) the largest < k; an offset
moves so many keys up (or down, if negative); beyond either end the result is null.

Keys and probes are sorted together, by ranges: one exchange, after which each task walks its own range and numbers its
keys; a key's rank is that number plus the sizes of the ranges before, so no task sorts all keys. A probe has the rank that the
walk met it at, and the answer is one equi-join on rank.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import cut


@dataclass(frozen=True)
class KeySelector:
    key: bytes
    or_equal: bool
    offset: int

    def add(self, n: int) -> KeySelector:
        return KeySelector(self.key, self.or_equal, self.offset + n)

    def subtract(self, n: int) -> KeySelector:
        return self.add(-n)

    def sign(self) -> int:
        """-1, 0 or 1: whether the offset points below, at or above the key."""
        return (self.offset > 0) - (self.offset < 0)

    def __str__(self) -> str:
        """As a constructor's call, with first_greater_or_equal as the base of all others."""
        for make in (first_greater_or_equal, first_greater_than, last_less_or_equal, last_less_than):
            if make(self.key) == self:
                return f"{make.__name__}({self.key!r})"
        n = self.offset if self.or_equal else self.offset - 1
        return f"first_greater_or_equal({self.key!r}) {'+' if n > 0 else '-'} {abs(n)}"


def first_greater_or_equal(key: bytes) -> KeySelector:
    return KeySelector(key, True, 0)


def first_greater_than(key: bytes) -> KeySelector:
    return KeySelector(key, True, 1)


def last_less_or_equal(key: bytes) -> KeySelector:
    return KeySelector(key, True, -1)


def last_less_than(key: bytes) -> KeySelector:
    return KeySelector(key, False, 0)


#: What a row is when it is walked: a probe before its key, a key, a probe after its key.
_BEFORE, _KEY, _AFTER = 0, 1, 2


def _numbered(batches):
    """Adds to rows (key, what), sorted, the range and how many keys of the range come before."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        is_key = batch.column(1).to_numpy() == _KEY
        upto = n + np.cumsum(is_key)
        n = int(upto[-1]) if len(upto) else n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(is_key), part, np.int32)), pa.array((upto - is_key).astype(np.int64))], ["key", "what", "part", "n"])


def ranked(keys: DataFrame, probes: DataFrame, ranges: int | None = None) -> DataFrame:
    """key, what, rank: of each key its rank from 0, of each probe how many keys are below (what 0) and not above it (what 2)."""
    rows = keys.select("key", F.lit(_KEY).alias("what")).unionByName(probes.select(F.col("probe").alias("key")).distinct().select("key", F.explode(F.array(F.lit(_BEFORE), F.lit(_AFTER))).alias("what")))
    by_range = rows.repartitionByRange(ranges, "key") if ranges else rows.repartitionByRange("key")
    kind = rows.schema["key"].dataType.simpleString()
    walked = cut(by_range.sortWithinPartitions("key", "what").mapInArrow(_numbered, f"key {kind}, what int, part int, n long"))
    sizes = walked.groupBy("part").agg(F.count_if(F.col("what") == _KEY).alias("size"))  # a row for each range
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return walked.join(F.broadcast(before), "part").select("key", "what", (F.col("n") + F.col("before")).alias("rank"))


def resolve(keys: DataFrame, probes: DataFrame, ranges: int | None = None) -> DataFrame:
    """probes with `found`: probes have probe, kind (a constructor's name) and offset; keys have distinct key."""
    rows = ranked(keys, probes, ranges)
    kind, at = F.col("kind"), lambda what: F.max(F.when(F.col("what") == what, F.col("rank")))
    counts = rows.where(F.col("what") != _KEY).groupBy(F.col("key").alias("probe")).agg(at(_BEFORE).alias("below"), at(_AFTER).alias("upto"))
    base = (
        F.when(kind == "first_greater_or_equal", F.col("below")).when(kind == "first_greater_than", F.col("upto"))
        .when(kind == "last_less_or_equal", F.col("upto") - 1).when(kind == "last_less_than", F.col("below") - 1)
    )
    wanted = probes.join(counts, "probe").withColumn("rank", base + F.col("offset"))
    order = rows.where(F.col("what") == _KEY).select("rank", F.col("key").alias("found"))
    return wanted.join(order, "rank", "left").drop("rank", "below", "upto")


def scalar(rows: DataFrame, selector: KeySelector) -> DataFrame:
    """The one row a selector resolves to, or none: a filter and a top-k."""
    k, n = F.lit(bytearray(selector.key)), selector.offset
    key = F.col("key")
    if not selector.or_equal:
        n -= 1  # last_less_than stands one before the first key >= k
        up, down = key >= k, key < k
    elif n > 0:
        n -= 1
        up, down = key > k, key <= k
    elif n < 0:
        up, down = key > k, key <= k
    else:
        up, down = key >= k, key < k
    if n >= 0:
        return rows.where(up).orderBy("key").offset(n).limit(1)
    return rows.where(down).orderBy(F.desc("key")).offset(-n - 1).limit(1)


class InvalidRange(ValueError):
    """A range whose start resolves above its end."""


def range_between(rows: DataFrame, start: KeySelector, end: KeySelector, limit: int = 10_000) -> DataFrame:
    """Rows from the key that start resolves to up to, not including, the one that end resolves to.

    A start beyond the keys gives no rows; an end beyond them leaves the range open.
    """
    low, high = (scalar(rows.select("key"), s).first() for s in (start, end))
    if low is None:
        return rows.limit(0)
    if high is not None and low["key"] > high["key"]:
        raise InvalidRange("invalid_range")
    found = rows.where(F.col("key") >= F.lit(low["key"]))
    if high is not None:
        found = found.where(F.col("key") < F.lit(high["key"]))
    return found.orderBy("key").limit(limit)
