"""Atomic operations folded over a log, by key and in (version, txn, seq) order."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import atomics
from ..functions.keys import MAX_VALUE, le_decode, le_encode

#: Order of a log's rows.
ORDER = ("version", "txn", "seq")


def commutative(log: DataFrame, op: str, width: int) -> DataFrame:
    """key, value of one commutative op whose operands all have `width` bytes (at most 7).

    A plain aggregate: partial results are combined before the shuffle, so a hot key costs no more.
    add wraps to a width + 1 result only through its final carry, so it needs sums below 256^width.
    """
    n = le_decode(F.col("operand"))
    total = {"add": F.sum(n), "min": F.min(n), "max": F.max(n), "bit_and": F.bit_and(n), "bit_or": F.bit_or(n), "bit_xor": F.bit_xor(n)}[op]
    return log.groupBy("key").agg(total.alias("n")).select("key", le_encode(F.col("n"), width).alias("value"), "n")


def bytewise(log: DataFrame, op: str) -> DataFrame:
    """byte_min or byte_max of operands of one width, as an aggregate over binary order."""
    best = {"byte_min": F.min, "byte_max": F.max}[op]("operand")
    return log.groupBy("key").agg(best.alias("value"))


def _joined(values: Column) -> Column:
    """An array of binary values as one, in a single pass."""
    return F.unhex(F.array_join(F.transform(values, F.hex), ""))


def append_if_fits(log: DataFrame, limit: int = MAX_VALUE) -> DataFrame:
    """key, value: operands joined in order, leaving out those that would pass the limit.

    A running sum finds what fits without a gap: at most `limit` bytes of a key. Of the operands after the first one that did not
    fit, those larger than the room left can never fit; only the others are folded one by one.
    """
    order, size = Window.partitionBy("key").orderBy(*ORDER), F.octet_length("operand")
    rows = log.select("key", *ORDER, "operand").withColumn("run", F.sum(size).over(order))
    fits = F.max(F.when(F.col("run") <= limit, F.col("run"))).over(Window.partitionBy("key"))
    rows = rows.withColumn("room", limit - F.coalesce(fits, F.lit(0))).where((F.col("run") <= limit) | ((size <= F.col("room")) & (size > 0)))
    at = F.struct(*ORDER, "operand")
    both = rows.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("run") <= limit, at))).alias("first"), F.array_sort(F.collect_list(F.when(F.col("run") > limit, at))).alias("later")
    )
    value = _joined(F.transform("first", lambda x: x["operand"]))
    more = F.aggregate("later", value, lambda v, x: F.when(F.octet_length(v) + F.octet_length(x["operand"]) <= limit, F.concat(v, x["operand"])).otherwise(v))
    return log.select("key").distinct().join(both.select("key", more.alias("value")), "key", "left").select("key", F.coalesce("value", F.unhex(F.lit(""))).alias("value"))


def compare_and_clear(log: DataFrame) -> DataFrame:
    """key, value after sets (op set) and compare_and_clear operands in order; null: cleared or missing.

    Only what follows a key's newest set matters, and there any equal operand clears it: two aggregates, whatever the order.
    """
    at = F.struct(*ORDER)
    newest = log.groupBy("key").agg(F.max_by(F.struct(at.alias("at"), "operand"), F.when(F.col("op") == "set", at)).alias("x"))
    newest = newest.select("key", "x.at", F.col("x.operand").alias("value"))
    equal = log.where("op <> 'set'").join(newest, "key").where((at > F.col("at")) & (F.col("operand") == F.col("value"))).select("key").distinct()
    gone = equal.withColumn("gone", F.lit(True))
    return newest.join(gone, "key", "left").select("key", F.when(F.col("gone").isNull(), F.col("value")).alias("value"))


def general(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """key, value after any mix of set, clear and atomic ops of any width, starting at base (key, value).

    The fallback for what the aggregates above cannot express. The log is first reduced to what follows each key's newest set or
    clear, which an ordered fold never looks past; then sorted partitions are walked with one value in hand, so
    a key with many operations needs no memory for them.
    """
    start = log.where(F.col("op").isin("set", "clear")).groupBy("key").agg(F.max(F.struct(*ORDER)).alias("from"))
    rows = log.join(start, "key", "left").where(F.col("from").isNull() | (F.struct(*ORDER) >= F.col("from")))
    rows = rows.select("key", *ORDER, "op", "operand")
    if base is not None:
        first = base.select("key", F.lit(-1).cast("long").alias("version"), F.lit(-1).alias("txn"), F.lit(-1).alias("seq"), F.lit("set").alias("op"), F.col("value").alias("operand"))
        rows = rows.unionByName(first)
    kind = rows.schema["key"].dataType
    arrow = to_arrow_type(kind)

    def fold(batches):
        key, value, begun = None, None, False
        for batch in batches:
            out = []
            for k, op, operand in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or k != key:
                    if begun:
                        out.append((key, value))
                    key, value, begun = k, None, True
                value = operand if op == "set" else None if op == "clear" else atomics.apply(op, value, operand)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], arrow), pa.array([x[1] for x in out], pa.binary())], ["key", "value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([key], arrow), pa.array([value], pa.binary())], ["key", "value"])

    ordered = rows.repartition("key").sortWithinPartitions("key", *ORDER).select("key", "op", "operand")
    return ordered.mapInArrow(fold, f"key {kind.simpleString()}, value binary")


def superseded(log: DataFrame) -> DataFrame:
    """What a transaction commits: of its single-key operations on a key only the last; range clears
    stay and drop the earlier single-key operations in their range."""
    single = log.where("op != 'clear_range'")
    clears = log.where("op = 'clear_range'").select(
        F.col("version").alias("cv"), F.col("txn").alias("ct"), F.col("seq").alias("cs"), F.col("key").alias("from_key"), F.col("end_key").alias("to_key")
    )
    last = single.groupBy("version", "txn", "key").agg(F.max_by(F.struct(*[c for c in single.columns if c not in ("version", "txn", "key")]), "seq").alias("x"))
    last = last.select("version", "txn", "key", "x.*").select(*single.columns)
    covered = (F.col("version") == F.col("cv")) & (F.col("txn") == F.col("ct")) & (F.col("seq") < F.col("cs")) & (F.col("key") >= F.col("from_key")) & (F.col("key") < F.col("to_key"))
    return last.join(clears, covered, "left_anti").unionByName(log.where("op = 'clear_range'"))
