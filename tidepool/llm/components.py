"""Connected components of a link table, by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


#: Edges that a task may read; a round never has more edges than the one before, so few edges need few tasks.
EDGES_A_TASK = 50_000


def _spread(df: DataFrame) -> DataFrame:
    """An exchange of its own below a join on u, so that the join's other side can be split where it is skewed."""
    return df.repartition(F.xxhash64("u"))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of links (a, b: long) with root != node.

    Each round points every node's larger neighbours at its smallest one, then its smaller neighbours
    at the smallest; the number of rounds grows with the logarithm of the longest chain. Hubs are safe:
    minima are aggregated before the shuffle and the joins are ones that Spark splits where skewed.
    """
    e = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, parts = now, 1 + now[0] // EDGES_A_TASK
        e = e.coalesce(parts)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(_spread(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.coalesce(parts))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_spread(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
