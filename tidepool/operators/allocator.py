"""Short unique ids: windows of candidates, counters and recently taken ones."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import candidate_bytes, window_size


def windows(ids: DataFrame, id_col: str) -> DataFrame:
    """start, size, allocated: the windows that the ids fall into, as allocation from 0 up would have opened them."""
    i = F.col(id_col)
    # windows of 64 up to 256, of 1024 up to 65536, then of 8192; each begins where the one before ends
    first_1k, first_8k = 256, 256 + 1024 * 64
    start = F.when(i < first_1k, F.floor(i / 64) * 64).when(i < first_8k, first_1k + F.floor((i - first_1k) / 1024) * 1024).otherwise(first_8k + F.floor((i - first_8k) / 8192) * 8192)
    return ids.groupBy(start.cast("long").alias("start")).agg(F.count(F.lit(1)).alias("allocated")).withColumn("size", window_size(F.col("start")))


def stats(counters: DataFrame) -> DataFrame:
    """latest_window_start, total_counters, estimated_allocated of counters (start, allocated)."""
    return counters.agg(
        F.coalesce(F.max("start"), F.lit(0)).cast("long").alias("latest_window_start"), F.count(F.lit(1)).alias("total_counters"), F.coalesce(F.sum("allocated"), F.lit(0)).cast("long").alias("estimated_allocated")
    )


#: Where windows of each size begin, and the size.
WINDOWS = [(0, 64), (256, 1024), (65_792, 8192)]


def _window(start: int) -> int:
    return next(size for first, size in reversed(WINDOWS) if start >= first)


def allocated(requests: DataFrame, number: str, seed: int = 1, start: int = 0, used: int = 0) -> DataFrame:
    """requests (number: 0, 1, ...) with window, candidate and packed: an id of its own for each.

    Windows fill by half: the request that would make a window half full opens the next one, so a window of w ids gives
    w / 2 - 1 of them, spread over all of it by a permutation that the seed and the window choose. start, used: the window
    that is open and how many ids it has given. Everything follows from the number, so requests are served in any order, by any
    number of tasks, without a counter that all must change.
    """
    given, found = F.col(number).cast("long") + used, F
    at, left = start, 0
    for begins, size in WINDOWS:
        ends = next((b for b, _ in WINDOWS if b > begins), None)
        at = max(at, begins)
        if ends is not None and at >= ends:
            continue
        each = size // 2 - 1
        many = None if ends is None else -(-(ends - at) // size) * each
        i = given - left
        here = F.struct((F.lit(at) + F.floor(i / each) * size).cast("long").alias("window"), (i % each).cast("long").alias("i"), F.lit(size).cast("long").alias("size"))
        found = found.when(F.lit(True) if many is None else given < left + many, here)
        left += many or 0
        at = ends if ends is not None else at
    rows = requests.withColumn("__w", found)
    # an odd factor permutes a window, whose size is a power of two
    shift = F.col("__w.window") / F.col("__w.size") * seed + seed
    place = ((2 * seed + 1) * F.col("__w.i") + shift.cast("long")) % F.col("__w.size")
    rows = rows.withColumn("window", F.col("__w.window")).withColumn("candidate", F.col("__w.window") + place).drop("__w")
    return rows.withColumn("packed", candidate_bytes(F.col("candidate")))


def allocate_many(taken: DataFrame, id_col: str, n: int, seed: int = 1) -> DataFrame:
    """id and packed of n unused ids: in the window after the last one that an id is taken from."""
    top = taken.agg(F.coalesce(F.max(id_col), F.lit(-1)).cast("long").alias("top")).first()["top"]
    begins = next(b for b, _ in reversed(WINDOWS) if max(top, 0) >= b)
    start = 0 if top < 0 else begins + ((top - begins) // _window(top) + 1) * _window(top)
    ids = allocated(taken.sparkSession.range(n).withColumnRenamed("id", "n"), "n", seed, start)
    return ids.select(F.col("candidate").alias("id"), "packed")
