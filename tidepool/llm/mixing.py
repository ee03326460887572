"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of copies each of its documents should have: a whole
part, which every document gets, and a fraction p. The fractions are rounded together. Two documents
hold p * size words each; one moves words to the other until one of them holds none or its full size
(then it is decided), and the direction is drawn so that no document's expected words change. The
words of a pair are the same before and after, so a whole source misses its target by less than one
document. Documents are dealt by hash into small groups of their source, each group is folded to one
undecided residual, and residuals are folded again, level by level: a reduction tree in which no task
holds more than a few groups whatever the size of a source.

Draws are hashes of the document's keys and a seed, so reruns agree whatever the partitioning.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources
whose size is 0 have target 0 and take nothing; a very long text is one unit like others, so its source may miss its target by
as much as its words; ties in draws go by hash; repeated rows are units of their own and each gets a
row; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a group folds, on average.
GROUP = 64


def units_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size in words, th (hash of the text) and dup (1, 2, ... among equal rows)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("th"),
    )
    n = rows.groupBy("id", "source", "size", "th").agg(F.count(F.lit(1)).alias("n"))
    return n.select("id", "source", "size", "th", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("dup"))


def _in_order(sources: DataFrame) -> DataFrame:
    """sources with rn: 1, 2, ... by code point, null last. Ranges of names are numbered apart, so no task holds all sources."""
    ranged = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k"))  # a row for each partition
    before = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("place", place).join(F.broadcast(before), "part").withColumn("rn", F.col("before") + F.col("place")).drop("part", "before", "place")


def source_targets(units: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target: a row for each source.

    weight * level, or `most` times the source where that is less. The level starts at share * all sizes over all weights; the
    excess of the sources that are full at a level raises it for the others, until no more are full. Each step is one aggregate of
    whole numbers over the sources, so the level has the same bits in every run.
    """
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    s = cut(_in_order(sizes).withColumn("w", w).drop("rn"))
    size, all_w = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    cap, level, full_w = F.col("source_size") * F.lit(float(most)), 0.0, -1
    full_size, now = 0, 0
    while now != full_w and now < all_w:
        full_w, level = now, (share * size - most * full_size) / (all_w - now)
        full = cap <= F.col("w") * F.lit(level)
        full_size, now = s.where(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    target = F.least(cap, F.col("w") * F.lit(level)) if now < all_w else cap
    return s.select("source", "source_size", "n", target.alias("target"))


def _uniform(*cols: Column, seed: int) -> Column:
    """In [0, 1), from the hash of the columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


_STATE = "struct<cur:struct<h:bigint,id:{id},th:bigint,dup:bigint,size:bigint,mass:double>,out:array<struct<id:{id},th:bigint,dup:bigint,size:bigint,draw:int>>>"


def _fold(items: Column, id_type: str, seed: int) -> Column:
    """Folds an array of units into cur, the one still undecided, and out, the decided ones."""
    settled = lambda x, v: F.array(F.struct(x["id"].alias("id"), x["th"].alias("th"), x["dup"].alias("dup"), x["size"].alias("size"), F.lit(v).alias("draw")))
    holding = lambda x, m: F.struct(x["h"].alias("h"), x["id"].alias("id"), x["th"].alias("th"), x["dup"].alias("dup"), x["size"].alias("size"), m.alias("mass"))
    state = lambda cur, out: F.struct(cur.alias("cur"), out.alias("out"))

    def meet(acc: Column, b: Column) -> Column:
        a, out = acc["cur"], acc["out"]
        room_a, room_b = a["size"] - a["mass"], b["size"] - b["mass"]
        to_b, to_a = F.least(a["mass"], room_b), F.least(b["mass"], room_a)
        u = _uniform(a["h"], b["h"], seed=seed)
        forth = (u * (to_b + to_a) < to_a) | (to_b + to_a <= 0)
        both = a["mass"] + b["mass"]
        return (
            F.when(forth & (a["mass"] <= room_b), state(holding(b, both), F.concat(out, settled(a, 0))))
            .when(forth, state(holding(a, a["mass"] - room_b), F.concat(out, settled(b, 1))))
            .when(b["mass"] <= room_a, state(holding(a, both), F.concat(out, settled(b, 0))))
            .otherwise(state(holding(b, b["mass"] - room_a), F.concat(out, settled(a, 1))))
        )

    kind = _STATE.format(id=id_type)
    first = F.struct(items[0].alias("cur"), F.array().cast(kind.split("out:")[1][:-1]).alias("out")).cast(kind)
    return F.aggregate(F.slice(items, 2, F.size(items)), first, lambda acc, b: meet(acc, b).cast(kind))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20,
) -> DataFrame:
    """id, th, dup, source, size, source_size, target, copies: how often the mix takes each row."""
    units = cut(units_of(docs, id_col, text_col, source_col))
    id_type = units.schema["id"].dataType.simpleString()
    targets = cut(source_targets(units, weights, share, most))
    found = targets.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).first()
    small = F.broadcast(targets) if found["k"] <= 100_000 else targets
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = units.join(small.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    dealt = dealt.withColumn("whole", F.floor(copies).cast("int")).withColumn("p", copies - F.col("whole"))
    h = F.xxhash64("id", "source", "th", "dup", F.lit(seed))
    about = ["source", "source_size", "target", "whole"]
    free = (F.col("p") > 0) & (F.col("size") > 0)
    unit = F.struct(h.alias("h"), "id", "th", "dup", "size", (F.col("p") * F.col("size")).alias("mass"))
    groups = F.ceil(F.col("n") / GROUP)
    level = dealt.where(free).select(*about, F.pmod(h, groups).alias("g"), unit.alias("x"))
    whole = dealt.where(~free).select(*about, "id", "th", "dup", "size", F.lit(0).alias("draw"))
    parts = [whole]
    most_groups = -(-(found["n"] or 0) // GROUP)
    while True:
        folded = level.groupBy(*about, "g").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        folded = cut(folded.select(*about, "g", _fold(F.col("xs"), id_type, seed).alias("f")))
        parts.append(folded.select(*about, F.explode("f.out").alias("o")).select(*about, "o.*"))
        level = folded.select(*about, F.floor(F.col("g") / GROUP).alias("g"), F.col("f.cur").alias("x"))
        if most_groups <= 1:
            break
        most_groups = -(-most_groups // GROUP)
    x = F.col("x")
    last = (_uniform(x["h"], seed=seed + 1) * x["size"] < x["mass"]).cast("int")
    parts.append(level.select(*about, x["id"].alias("id"), x["th"].alias("th"), x["dup"].alias("dup"), x["size"].alias("size"), last.alias("draw")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "th", "dup", "source", "size", "source_size", "target", (F.col("whole") + F.col("draw")).alias("copies"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: every row of docs as often as the mix takes it."""
    counts = mix(docs, id_col, text_col, source_col, **options).groupBy("id", "source", "th")
    counts = cut(counts.agg(F.sum("copies").alias("k"), F.count(F.lit(1)).alias("m")).where("k > 0"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("row_id"), F.col(source_col).cast("string").alias("row_source"), F.xxhash64(text_col).alias("row_th"))
    k = F.col("k")
    if counts.where("m > 1").limit(1).count():  # rows equal in all columns are one row that stands for n; those that differ in others share the copies
        same = ["row_id", "row_source", "row_th"]
        rows = rows.withColumn("h", F.xxhash64(F.to_json("doc"))).groupBy(*same, "h").agg(F.first("doc").alias("doc"), F.count(F.lit(1)).alias("n"))
        rows = rows.withColumn("to", F.sum("n").over(Window.partitionBy(*same).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
        upto = lambda x: F.floor(k * x / F.col("m"))
        k = (upto(F.col("to")) - upto(F.col("to") - F.col("n"))).cast("long")
    met = rows.join(counts, F.col("row_id").eqNullSafe(F.col("id")) & F.col("row_source").eqNullSafe(F.col("source")) & (F.col("row_th") == F.col("th")))
    met = met.select("doc", k.alias("k")).where("k > 0")
    return met.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).select("doc.*")
