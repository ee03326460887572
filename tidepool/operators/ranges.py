"""Ranges as rows (s, e: half-open): coalescing, segments, overlap joins and range clears.

Bounds are integers or binary keys. Ranges meet without a nested loop and without a grid width to choose: a range's
level is the coarsest place in a hierarchy of cells (each level's cells are 16 of the level's below) at which it
touches two cells at most. Two ranges meet by an equi-join on level and cell, at the higher of their two levels, so
a range is copied twice a level that the other side really has, however wide it is.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType

from ..functions.keys import key_after_col

#: Bits of one level.
STEP = 4
#: Bytes of a binary key, after the start that all keys share, that place it.
PLACED_BYTES = 7


def coalesce_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """by..., s, e: overlapping and touching ranges of a group merged into one."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def segments(ranges: DataFrame, by: list[str], what: str) -> DataFrame:
    """by..., s, e, members: the stretches between all range bounds, with the ranges that cover each.

    Stretches and ranges meet by an overlap join, whose result is as large as the memberships are.
    """
    w = Window.partitionBy(*by).orderBy("s")
    bounds = ranges.select(*by, F.explode(F.array("s", "e")).alias("s")).distinct().withColumn("e", F.lead("s").over(w)).where("e is not null")
    cover = overlap_join(bounds, ranges.select(*by, F.col("s").alias("rs"), F.col("e").alias("re"), F.col(what).alias("member")), by, ("s", "e"), ("rs", "re"))
    return cover.groupBy(*by, "s", "e").agg(F.array_sort(F.collect_set("member")).alias("members"))


def _shared_start(sides: list[tuple[DataFrame, str, str]]) -> int:
    """How many bytes all bounds start with alike."""
    found = [df.agg(F.min(s), F.max(e)).first() for df, s, e in sides]
    ends = [bytes(x) for row in found for x in row if x is not None]
    return len(os.path.commonprefix(ends))


def _place(key: Column, skip: int | None) -> Column:
    """An order-preserving integer (not always a different one for different keys)."""
    if skip is None:
        return key.cast("long")
    digits = F.rpad(F.hex(F.substr(key, F.lit(skip + 1), F.lit(PLACED_BYTES))), 2 * PLACED_BYTES, "0")
    return F.conv(digits, 16, 10).cast("long")


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _level(lo: Column, hi: Column) -> Column:
    span = hi - lo
    bits = F.when(span <= 0, 0).otherwise(F.length(F.bin(span)))
    return F.least(F.ceil(bits / STEP) * STEP, F.lit(60)).cast("int")  # the top one has sixteen cells


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("__own").distinct().collect())  # 16 at most


def _dealt(df: DataFrame, others: list[int], lo: str, hi: str, own: str) -> DataFrame:
    """df with a row for each cell it touches at its own level and at higher ones that the other side has."""
    levels = F.concat(F.array(F.col(own)), F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col(own)))
    cells = F.flatten(F.transform(levels, lambda x: F.transform(F.sequence(_right(F.col(lo), x), _right(F.col(hi), x)), lambda c: F.struct(x.alias("__level"), c.alias("__cell")))))
    return df.withColumn("__at", F.explode(cells)).select("*", "__at.*").drop("__at")


def _meet(left: DataFrame, right: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str], meets: Column) -> DataFrame:
    """Pairs with equal `by` for which `meets` holds; it must imply that the closed ranges of their places overlap."""
    skip = _shared_start([(left, *a), (right, *b)]) if isinstance(left.schema[a[0]].dataType, BinaryType) else None
    one = left.withColumn("__lo1", _place(F.col(a[0]), skip)).withColumn("__hi1", _place(F.col(a[1]), skip))
    two = right.withColumn("__lo2", _place(F.col(b[0]), skip)).withColumn("__hi2", _place(F.col(b[1]), skip))
    one, two = one.withColumn("__own", _level(F.col("__lo1"), F.col("__hi1"))), two.withColumn("__own", _level(F.col("__lo2"), F.col("__hi2")))
    of_one, of_two = _levels(one), _levels(two)
    one = _dealt(one.withColumnRenamed("__own", "__own1"), of_two, "__lo1", "__hi1", "__own1")
    two = _dealt(two.withColumnRenamed("__own", "__own2"), of_one, "__lo2", "__hi2", "__own2")
    at = (F.col("__level") == F.greatest("__own1", "__own2")) & (F.col("__cell") == _right(F.greatest("__lo1", "__lo2"), F.col("__level")))  # where the overlap begins: once
    return one.join(two, [*by, "__level", "__cell"]).where(at & meets).drop("__level", "__cell", "__lo1", "__lo2", "__hi1", "__hi2", "__own1", "__own2")


def _grid(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / width).cast("long"), F.floor((hi - 1) / width).cast("long")))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str], grid: int | None = None) -> DataFrame:
    """Rows of left and right with equal `by` whose ranges overlap; integer or binary bounds.

    With a grid width (integer ranges of about that size or less), both sides are dealt to the grid cells that they
    touch instead, which saves the look at the data that finds the levels.
    """
    meets = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    left, right = left.where(F.col(a[0]) < F.col(a[1])), right.where(F.col(b[0]) < F.col(b[1]))
    if grid is None:
        return _meet(left, right, by, a, b, meets)
    one, two = left.withColumn("cell", _grid(F.col(a[0]), F.col(a[1]), grid)), right.withColumn("cell", _grid(F.col(b[0]), F.col(b[1]), grid))
    first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / grid) == F.col("cell")
    return one.join(two, [*by, "cell"]).where(meets & first).drop("cell")


def covering(points: DataFrame, ranges: DataFrame, key: str, by: list[str] | None = None, s: str = "s", e: str = "e") -> DataFrame:
    """Rows of points with each row of ranges whose [s, e) holds the key."""
    inside = (F.col(key) >= F.col(s)) & (F.col(key) < F.col(e))
    return _meet(points, ranges.where(F.col(s) < F.col(e)), by or [], (key, key), (s, e), inside)


def is_point(s: Column, e: Column, binary: bool) -> Column:
    """Whether [s, e) holds one key."""
    return e == (key_after_col(s) if binary else s + 1)


def apply_clears(sets: DataFrame, clears: DataFrame) -> DataFrame:
    """sets (k, version, value) whose newest entry of a key is not covered by a later clear (s, e, at).

    The newest entry of each key is found first (combined before the shuffle), then met with the clears that cover it.
    """
    last = sets.groupBy("k").agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))
    gone = covering(last.select("k", "version"), clears.select("s", "e", "at"), "k").where("at > version").select("k").distinct()
    return last.join(gone, "k", "left_anti")
