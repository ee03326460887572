"""Optimistic conflict detection: read ranges against later writes.

reads: txn, read_version, version, s, e. writes: txn, version, s, e. Integer or binary bounds. A reader conflicts with a
writer that committed after its read version and before its own.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from ..sources.scratch import cut
from .ranges import is_point, overlap_join

#: Conflicts that one task decides in order; more are reduced in rounds first.
EDGES_A_TASK = 2_000_000


def _points(ranges: DataFrame) -> DataFrame:
    return ranges.where(is_point(F.col("s"), F.col("e"), isinstance(ranges.schema["s"].dataType, BinaryType)))


def point_pairs(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """reader, writer where both ranges are single keys: an equi-join on the key."""
    r = _points(reads).select(F.col("txn").alias("reader"), "read_version", F.col("version").alias("at"), "s")
    w = _points(writes).select(F.col("txn").alias("writer"), F.col("version").alias("written"), "s")
    return r.join(w, "s").where("written > read_version and written < at").select("reader", "writer").distinct()


def pairs(reads: DataFrame, writes: DataFrame, grid: int | None = None, lag: int | None = None) -> DataFrame:
    """reader, writer of every conflict.

    lag: an upper bound of version - read_version. With it, both sides also meet on coarse version buckets,
    so that old writes never reach a reader's task. grid: as for overlap_join.
    """
    r = reads.select(F.col("txn").alias("reader"), "read_version", F.col("version").alias("at"), F.col("s").alias("rs"), F.col("e").alias("re"))
    w = writes.select(F.col("txn").alias("writer"), F.col("version").alias("written"), F.col("s").alias("ws"), F.col("e").alias("we"))
    by = []
    if lag:
        r = r.withColumn("epoch", F.explode(F.sequence(F.floor(F.col("read_version") / lag), F.floor(F.col("at") / lag))))
        w, by = w.withColumn("epoch", F.floor(F.col("written") / lag)), ["epoch"]
    met = overlap_join(r, w, by, ("rs", "re"), ("ws", "we"), grid)
    return met.where("written > read_version and written < at").select("reader", "writer").distinct()


def _in_order(batches):
    """Readers, in order, that an accepted writer conflicts with."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found).sort_by([("reader", "ascending")])
    rejected: set[int] = set()
    for reader, writer in zip(table["reader"].to_pylist(), table["writer"].to_pylist(), strict=True):
        if writer not in rejected:
            rejected.add(reader)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(rejected), pa.int64())], ["txn"])


def rejected(conflicts: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """txn: the readers that are refused when transactions are decided in txn order, an accepted writer's conflict refusing.

    conflicts: reader, writer (before the reader). What is decided depends on earlier decisions, so it goes in rounds: a
    writer that no conflict names as reader is accepted, its readers are refused, and refused writers' conflicts
    are void. As soon as few conflicts are left, one task decides them in order.
    """
    left = cut(conflicts.where("writer < reader").select("reader", "writer").distinct())
    found = None
    while (n := left.count()) > edges_a_task:
        open_ = left.select(F.col("reader").alias("writer")).distinct()
        refused = cut(left.join(open_, "writer", "left_anti").select("reader").distinct())
        found = refused if found is None else found.unionByName(refused)
        left = left.join(refused, "reader", "left_anti").join(refused.withColumnRenamed("reader", "writer"), "writer", "left_anti")
        left = cut(left.select("reader", "writer"))
    last = left.coalesce(1).mapInArrow(_in_order, "txn long")
    return last if found is None else last.unionByName(found.withColumnRenamed("reader", "txn"))


def resolve(txns: DataFrame, conflicts: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """txns with accepted: whether no accepted transaction before it, of its own batch or an earlier one, conflicts with it.

    txns: txn, ... in commit order. conflicts: every pair within the retained versions, as pairs() finds them.
    """
    no = rejected(conflicts, edges_a_task).select("txn", F.lit(False).alias("accepted"))
    return txns.join(no, "txn", "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))


def sharded(ranges: DataFrame, shards: DataFrame) -> DataFrame:
    """ranges (..., s, e) of reads or of writes, each cut at the resolvers' bounds: a row for each resolver it meets, with its tag.

    shards: tag, start, end. Cut parts cover the range without overlapping, so a conflict is found by the resolver of the key
    it is on; what any resolver refuses is refused (refused_by_any).
    """
    from .routing import clamp

    return clamp(ranges, shards)


def refused_by_any(decisions: DataFrame) -> DataFrame:
    """txn, accepted from the decisions (txn, tag, accepted) of all resolvers."""
    return decisions.groupBy("txn").agg(F.min("accepted").alias("accepted"))


def metrics(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """versions, points, ranges of a set of writes, and read ranges beside it."""
    binary = isinstance(writes.schema["s"].dataType, BinaryType)
    point = is_point(F.col("s"), F.col("e"), binary)
    w = writes.agg(F.countDistinct("version").alias("versions"), F.sum(point.cast("long")).alias("points"), F.sum((~point & (F.col("e") > F.col("s"))).cast("long")).alias("ranges"))
    return w.withColumn("reads", reads.agg(F.count(F.lit(1)).alias("reads")).scalar())


def retained(writes: DataFrame, last: int, window: int) -> DataFrame:
    """The writes that later checks can still need: those of the last `window` versions."""
    return writes.where(F.col("version") >= last - window)


def stale(txns: DataFrame, newest: int) -> DataFrame:
    """txns with stale: whether the batch follows a version (last_version) that is behind `newest`, which aborts it whole."""
    return txns.withColumn("stale", F.col("last_version") < newest)


def in_sequence(batches: DataFrame, newest: int) -> DataFrame:
    """batches (last_version, version) with state: what a resolver at version `newest` does with each.

    ready: it follows what is resolved, directly or through other batches here; parked: a predecessor is missing; stale: it
    follows an older version. A batch names its predecessor, and versions increase along the chain, so the first
    batch in version order whose predecessor is not the one before it ends the chain.
    """
    from pyspark.sql import Window

    order = Window.orderBy("version")  # a resolver's waiting batches, not transactions
    live = batches.where(F.col("last_version") >= newest)
    before = F.coalesce(F.lag("version").over(order), F.lit(newest))
    broken = F.sum((F.col("last_version") != before).cast("int")).over(order)
    found = live.withColumn("state", F.when(broken == 0, "ready").otherwise("parked"))
    return found.unionByName(batches.where(F.col("last_version") < newest).withColumn("state", F.lit("stale")))
