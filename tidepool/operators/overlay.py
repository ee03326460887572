"""A transaction's pending writes over a stored state."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranges import covering


def merged(stored: DataFrame, pending: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """key, value as the transaction sees it.

    stored: key, value. pending: key, value (null: cleared), the last single-key write of each key.
    cleared: s, e of range clears, which hide stored keys; writes after them are in pending and stay visible.
    """
    base = stored
    if cleared is not None:
        base = stored.join(covering(stored.select("key"), cleared.select("s", "e"), "key").select("key").distinct(), "key", "left_anti")
    p = pending.select("key", F.col("value").alias("new"), F.lit(True).alias("written"))
    both = base.join(p, "key", "full_outer")
    seen = both.select("key", F.when(F.col("written"), F.col("new")).otherwise(F.col("value")).alias("value"))
    return seen.where("value is not null")


def mutation_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """keys_added, keys_removed, keys_changed between two states (key, value)."""
    both = before.select("key", F.col("value").alias("b")).join(after.select("key", F.col("value").alias("a")), "key", "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(
        n(F.col("b").isNull() & F.col("a").isNotNull()).alias("keys_added"), n(F.col("a").isNull() & F.col("b").isNotNull()).alias("keys_removed"),
        n(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("keys_changed"),
    )
