"""Near-duplicate documents: MinHash bands, odd sketches, and confirmation on full shingle sets.

1. A document's set is its distinct five-word shingles. Documents with equal sets form a class, and one
   of them stands for it, so copies are never compared with each other.
2. Each class has MinHash samples. Bands of them propose pairs; the parity bitmap of all samples (an
   odd sketch) filters them: the population count of two bitmaps' XOR estimates how many samples
   differ. The filter's margin is wide enough that a pair at the threshold passes all but surely.
3. Pairs that pass are confirmed on the full sets. Links are never taken from an estimate.
4. Crowded buckets are not expanded into all pairs. Their first members meet each other, and of a later
   member's meetings with the very first ones only the most alike is confirmed. Confirmed links give
   components. Then only pairs of a crowded bucket whose ends are still in different components can
   matter. Of these, a pair at the threshold either shares one of the rarest quarter of its shingles
   that few of the crowded documents have, or consists of common ones to such a part that the
   numbers of common shingles alone allow the link: every document's quarter meets others by an equi-join
   whose groups are bounded, and pairs of the second kind are found in blocks. Members' most alike
   partners are confirmed first, then what is left. A passage that many documents share proposes no pairs.

A pair at the threshold is missed only if no band of it agrees (about one in ten thousand) and no
third document joins the two; components are otherwise exact.

Defined results: a null, empty or blank text has the empty set and links with nothing; documents of
fewer than five words have their whole sequence as one shingle; repeated rows each give a row and
belong together; a null id links with nothing and is kept, with a null component; an empty table
gives an empty result; other columns are ignored. Texts are read whole.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import cut, written
from .components import components
from .lattice_dedup import _groups
from .shingles import U, mix, shingle_sets

SAMPLES, ROWS, SKETCH_BITS = 96, 4, 256
BANDS = SAMPLES // ROWS
#: XOR population counts above this are not confirmed: a pair of similarity 0.75 passes but for one in ten thousand.
MOST_DIFFERENT = 66
#: Members of a bucket that all meet each other, and those that any later member meets.
ALL_PAIRS, PIVOTS = 12, 4
#: Shingles that so many crowded documents have are common, and how many common ones may be broadcast (8 bytes each).
COMMON, MOST_COMMON = 64, 4_000_000
#: Members of a block of a crowded bucket.
BLOCK = 256
#: Pairs with one document that meet one copy of its set.
PAIRS_A_COPY = 128
#: Bytes of text hashed at a time.
STEP = 1 << 20

_FACTORS = np.random.default_rng(97).integers(0, 2**63, SAMPLES, dtype=np.uint64) * U(2) + U(1)


def text_blocks(col: pa.Array):
    """(first row, bytes, ends) for stretches of rows of about STEP bytes; a null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def minhash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SAMPLES minima for each of the non-empty sets that lie one after the other in h."""
    out = np.zeros((len(n), SAMPLES), np.uint64)
    starts = np.cumsum(n) - n
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + 16384)))
        x = h[starts[a] : starts[b - 1] + n[b - 1]]
        for j, f in enumerate(_FACTORS):
            out[a:b, j] = np.minimum.reduceat(x * f, starts[a:b] - starts[a])
        a = b
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """A bitmap row for each row of samples: every sample flips one bit."""
    n = len(samples)
    place = mix(samples + np.arange(SAMPLES, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) % U(SKETCH_BITS)
    flips = np.zeros((n, SKETCH_BITS), np.uint8)
    np.add.at(flips, (np.repeat(np.arange(n), SAMPLES), place.ravel().astype(np.int64)), 1)
    return np.packbits(flips & 1, axis=1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    k = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(samples), 0)
    for r in range(ROWS):
        k = mix(k * U(0x9E3779B97F4A7C15) + samples[:, r::ROWS])
    return k.view(np.int64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that an XOR population count speaks for."""
    share = np.minimum(2 * differing / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS / 2 * np.log(1 - share) / (2 * SAMPLES)


def _signatures(batches):
    for batch in batches:
        for at, data, ends in text_blocks(batch.column(1)):
            h, n = shingle_sets(data, ends)
            some = np.flatnonzero(n)
            samples = minhash(h, n[some])
            keys, bands, sketch = [None] * len(n), [None] * len(n), [None] * len(n)
            starts = np.cumsum(n) - n
            bk, sk = band_keys(samples), odd_sketch(samples) if len(some) else None
            for j, i in enumerate(some.tolist()):
                keys[i] = hashlib.blake2b(h[starts[i] : starts[i] + n[i]].tobytes(), digest_size=16).digest()
                bands[i], sketch[i] = bk[j], sk[j].tobytes()
            ids = batch.column(0).slice(at, len(n))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["id", "n", "key", "bands", "sketch"]
            )


def _sets(batches):
    for batch in batches:
        for at, data, ends in text_blocks(batch.column(1)):
            h, n = shingle_sets(data, ends)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), lists], ["id", "s"])


def _sketch_matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _alike(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The XOR counts, and where they and the set sizes leave 100 * intersection >= 75 * union possible."""
    d = np.bitwise_count(sa ^ sb).sum(-1, dtype=np.int64)
    return d, (d <= MOST_DIFFERENT) & (100 * np.minimum(na, nb) >= 75 * np.maximum(na, nb))


def _meetings(batches, all_pairs: int, pivots: int):
    """Rows (band, rep, n, sketch, comp) sorted by band; comp -1 is a component of its own. kind 0: a pair among first members; kind 1: a crowded band (in a);
    kind 2: a later member (a) and a very first one (b). d: the pair's XOR count."""
    held = None  # the first rows of the run that may go on
    length = 0  # of that run so far
    for batch in batches:
        if not batch.num_rows:
            continue
        band, rep, n, comp = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
        sk = _sketch_matrix(batch.column(3))
        old, before = 0, 0
        if held is not None and held[0][0] == band[0]:
            old, before = len(held[0]), length
            band, rep, n, sk, comp = (np.concatenate([x, y]) for x, y in zip(held, (band, rep, n, sk, comp), strict=True))
        start = np.concatenate([[True], band[1:] != band[:-1]])
        begin = np.maximum.accumulate(np.where(start, np.arange(len(band)), 0))
        pos = np.arange(len(band)) - begin
        pos[old : len(pos)] += np.where(begin[old:] == 0, before - old, 0)  # rows that aren't held any more
        out: list[tuple] = []

        def meet(kind: int, i: np.ndarray, j: np.ndarray) -> None:
            d, ok = _alike(sk[i], sk[j], n[i], n[j])
            ok &= (comp[i] != comp[j]) | (comp[i] < 0)
            x, y, d = rep[i[ok]], rep[j[ok]], d[ok]
            out.append((np.full(len(d), kind), *((np.minimum(x, y), np.maximum(x, y)) if kind == 0 else (x, y)), d))

        fresh = np.arange(len(band)) >= old
        early = fresh & (pos < all_pairs)
        for lag in range(1, all_pairs):
            i = np.flatnonzero(early & (pos >= lag))
            if not len(i):
                break
            meet(0, i, i - lag)
        late = np.flatnonzero(fresh & (pos >= all_pairs))
        for p in range(pivots if len(late) else 0):
            meet(2, late, begin[late] + p)
        crowded = band[fresh & (pos == all_pairs)]
        out.append((np.ones(len(crowded), np.int64), crowded, crowded, np.zeros(len(crowded), np.int64)))
        kind, a, b, d = (np.concatenate(c) for c in zip(*out, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a), pa.array(b), pa.array(d, pa.int32())], ["kind", "a", "b", "d"])
        at = int(begin[-1])
        length = int(pos[-1]) + 1
        held = tuple(x[at : at + all_pairs].copy() for x in (band, rep, n, sk, comp))


def _cross(most_alike: bool):
    """Meetings of minor members (side 0, in a) with the members of a block (side 1, in b) of other components.

    A pair that shares several buckets meets in the first of them. Either each minor member's most alike
    partner of the block, or all pairs, once each.
    """

    def run(batches):
        for (band, _, _), t in _groups(batches, ("band", "i", "j")):
            side = t["side"].to_numpy()
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(x) or not len(y):
                continue
            rep, comp, n, common, sk = t["rep"].to_numpy(), t["comp"].to_numpy(), t["n"].to_numpy(), t["common"].to_numpy(), _sketch_matrix(t["sketch"])
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            minor = t["minor"].to_numpy()
            before = int(np.argmax(bands[0] == band))
            a, b, ds = [], [], []
            for i in x:
                d, ok = _alike(sk[y], sk[i], n[y], n[i])
                ok &= (comp[y] != comp[i]) & (7 * np.minimum(common[y], common[i]) >= 3 * (n[y] + n[i]))
                if not most_alike:
                    ok &= ~minor[y] | (rep[i] < rep[y])
                ok = np.flatnonzero(ok)
                ok = ok[~(bands[y[ok], :before] == bands[i, :before]).any(1)]
                if most_alike and len(ok):
                    ok = ok[[int(d[ok].argmin())]]
                a.append(np.full(len(ok), rep[i]))
                b.append(rep[y[ok]])
                ds.append(d[ok])
            a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(ds)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d, pa.int32())], ["a", "b", "d"])

    return run


def _shingles(batches):
    for batch in batches:
        for at, data, ends in text_blocks(batch.column(1)):
            h, _ = shingle_sets(data, ends)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["x"])


def common_shingles(texts: DataFrame) -> DataFrame:
    """x: the shingles that at least COMMON of these documents have."""
    counts = texts.mapInArrow(_shingles, "x long").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    return cut(counts.where(F.col("c") >= COMMON).select("x"))


def profiles(texts: DataFrame, most_common: int = MOST_COMMON) -> DataFrame:
    """id, common (how many common shingles) and rare (those of the rarest quarter that are not common).

    Up to `most_common` common shingles are broadcast; more are joined. The result is the same.
    """
    known = common_shingles(texts)
    if known.count() <= most_common:
        found = np.sort(known.toArrow()["x"].to_numpy())
        return texts.mapInArrow(_profiles(texts.sparkSession.sparkContext.broadcast(found)), "id long, common long, rare array<bigint>")
    rows = texts.mapInArrow(_id_shingles, "id long, x long").join(known.withColumn("often", F.lit(True)), "x", "left")
    by_id = rows.groupBy("id").agg(F.count("often").alias("common"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("often").isNull(), F.col("x")))).alias("xs"))  # a document's own
    return by_id.select("id", "common", F.slice("xs", F.lit(1), (F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1).cast("int")).alias("rare"))


def _id_shingles(batches):
    for batch in batches:
        for at, data, ends in text_blocks(batch.column(1)):
            h, n = shingle_sets(data, ends)
            ids = batch.column(0).slice(at, len(n))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(h.view(np.int64))], ["id", "x"])


def _profiles(shared):
    """For each document its common shingles, by bisection in the broadcast ones, and the smallest of the others."""

    def run(batches):
        for batch in batches:
            for at, data, ends in text_blocks(batch.column(1)):
                h, n = shingle_sets(data, ends)
                h, known = h.view(np.int64), shared.value
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, doc))
                h = h[order]
                place = np.searchsorted(known, h)
                is_common = (known[np.minimum(place, len(known) - 1)] == h) if len(known) else np.zeros(len(h), bool)
                common = np.bincount(doc, is_common, len(n)).astype(np.int64)
                rare, of = h[~is_common], doc[~is_common]
                first = np.cumsum(n - common) - (n - common)
                keep = np.arange(len(rare)) - first[of] <= (n - (3 * n + 3) // 4)[of]
                sizes = np.bincount(of[keep], minlength=len(n))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(rare[keep]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(common), lists], ["id", "common", "rare"])

    return run


def _few(df: DataFrame, n: int) -> DataFrame:
    """df, broadcast if its n rows of an id are known to be few."""
    return F.broadcast(df) if n <= 2_000_000 else df


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _most_alike(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each a the one with the fewest differing bits, as (a, b) in order."""
    best = pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x"))
    return _ordered(best.select("a", F.col("x.b").alias("b")))


def _only(docs: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """docs (id, text) with an id in nodes, one row an id. repeated: an id may stand on several (equal) rows."""
    texts = docs.join(_few(nodes, nodes.count()), F.col("id") == F.col("node"), "left_semi")
    return texts.dropDuplicates(["id"]) if repeated else texts


def _spread_over_copies(pairs: DataFrame, sets: DataFrame, side: str, other: str) -> tuple[DataFrame, DataFrame]:
    """pairs and sets with a copy number: a document of many pairs has a copy of its set for every PAIRS_A_COPY of them."""
    often = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_COPY).cast("int").alias("copies")).where("copies > 1")
    often = cut(often.withColumnRenamed(side, "of"))
    few = _few(often, often.count())
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(few, F.col(side) == F.col("of"), "left").withColumn(f"copy_{side}", F.pmod(F.xxhash64(other), copies).cast("int")).drop("of", "copies")
    own = sets.select(F.col("id").alias(side), F.col("s").alias(f"s{side}")).join(few, F.col(side) == F.col("of"), "left")
    return dealt, own.select(side, f"s{side}", F.explode(F.sequence(F.lit(0), copies - 1)).alias(f"copy_{side}"))


def confirmed(pairs: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    involved = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = _only(docs, involved, repeated)
    sets = texts.mapInArrow(_sets, "id long, s array<bigint>")
    pairs, one = _spread_over_copies(pairs.select("a", "b"), sets, "a", "b")
    pairs, two = _spread_over_copies(pairs, sets, "b", "a")
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(one, ["a", "copy_a"]).join(two, ["b", "copy_b"])
    return met.where(100 * both >= 75 * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _crowded_members(members: DataFrame, group: DataFrame) -> DataFrame | None:
    """Members of crowded buckets that hold several components: their columns, comp and minor; None if there are none."""
    m = members.join(group, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "rep")).drop("node", "root")
    per = m.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"))
    per = cut(per.groupBy("band").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1"))
    n = per.count()
    if not n:
        return None
    per = per.select("band", F.col("main.comp").alias("main"), F.col("m"), (F.col("m") - F.col("main.k")).alias("minors"))
    m = m.join(F.broadcast(per) if n <= 200_000 else per, "band")
    return m.withColumn("minor", F.col("comp") != F.col("main"))


def _blocks(m: DataFrame, most_alike: bool) -> DataFrame:
    """a, b, d: minor members (a) with members of other components (b) that common shingles may link, in blocks of both.

    Such a link needs 7 * common >= 3 * (n + n') on both sides and n' >= 3/4 n, so members with fewer common shingles than 3/4
    of their set go before any row is copied.
    """
    m = cut(m.where(4 * F.col("common") >= 3 * F.col("n")))
    size = m.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.count_if("minor").alias("minors")).where("minors > 0")
    m = m.drop("m", "minors").join(F.broadcast(size) if size.count() <= 200_000 else size, "band")
    rows = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    spread = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), rows(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), rows(n) - 1))
    cols = ("band", "rep", "n", "sketch", "bands", "comp", "common", "minor")
    minors = m.where("minor").select(*cols, F.lit(0).alias("side"), spread("minors", 1).alias("i"), every("m").alias("j"))
    others = m.select(*cols, F.lit(1).alias("side"), every("minors").alias("i"), spread("m", 2).alias("j"))
    dealt = minors.unionByName(others).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(_cross(most_alike), "a long, b long, d int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(texts.mapInArrow(_signatures, "id long, n long, key binary, bands array<bigint>, sketch binary"))
    linkable = rows.where("key is not null and id is not null")
    repeated = linkable.groupBy("id").count().where("count > 1").limit(1).count() > 0
    classes = cut(linkable.groupBy("key").agg(F.min(F.struct("id", "n", "bands", "sketch")).alias("x")).select("key", F.col("x.id").alias("rep"), "x.n", "x.bands", "x.sketch"))
    banded = classes.select(F.explode("bands").alias("band"), "rep", "n", "sketch")
    pairs = "kind int, a long, b long, d int"
    met = banded.withColumn("comp", F.lit(-1).cast("long")).repartition("band").sortWithinPartitions("band", F.xxhash64("rep"))
    met = cut(met.mapInArrow(lambda batches: _meetings(batches, ALL_PAIRS, PIVOTS), pairs).distinct())
    tested = cut(_ordered(met.where("kind = 0").select("a", "b").union(_most_alike(met.where("kind = 2").select("a", "b", "d")))))
    group = components(confirmed(tested, texts, repeated))
    crowded = met.where("kind = 1").select(F.col("a").alias("band"))
    n_crowded = crowded.count()
    if n_crowded:
        with_bands = classes.select(F.explode("bands").alias("band"), "rep", "n", "sketch", "bands")
        members = cut(with_bands.join(F.broadcast(crowded) if n_crowded <= 200_000 else crowded, "band", "left_semi"))
        known = None
        for most_alike in (True, False):
            m = _crowded_members(members, group)
            if m is None:
                break
            if known is None:
                known = cut(profiles(_only(texts, cut(m.select(F.col("rep").alias("node")).distinct()), repeated)))
            m = cut(m.join(known, F.col("rep") == F.col("id")))
            rare = m.dropDuplicates(["rep"]).select(F.explode("rare").alias("band"), "rep", "n", "sketch", "comp").repartition("band").sortWithinPartitions("band", "rep")
            by_rare = rare.mapInArrow(lambda batches: _meetings(batches, COMMON, 0), pairs).where("kind = 0").select("a", "b", "d")
            found = _blocks(m, most_alike).unionByName(by_rare).unionByName(by_rare.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
            new = cut((_most_alike(found) if most_alike else _ordered(found)).join(tested, ["a", "b"], "left_anti"))
            links = cut(confirmed(new, texts, repeated))
            tested = tested.unionByName(new)
            group = components(group.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    info = cut(classes.join(group, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("root", "rep").alias("component_id")))
    out = rows.select("id", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(info, "key", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates; rows of one id with different texts are documents of
    their own, equal ones are one, and every row without an id stays."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))  # columns of any name, as one
    named = rows.where(F.col("id").isNotNull())
    if not named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return _without_copies(rows).select("doc.*")
    # ids repeat: numbers in the order of the ids stand for id and text
    named = named.withColumn("th", F.xxhash64("text")).withColumn("dh", F.xxhash64(F.to_json("doc")))
    named = named.groupBy("id", "th").agg(F.min_by(F.struct("doc", "text"), "dh").alias("x")).select("id", "th", "x.*")
    named = named.repartitionByRange("id", "th").sortWithinPartitions("id", "th")
    named = written(named.select("doc", "text", F.monotonically_increasing_id().alias("id")), "near-dedup")
    return _without_copies(named).select("doc.*").union(rows.where(F.col("id").isNull()).select("doc.*"))


def _without_copies(rows: DataFrame) -> DataFrame:
    """rows (doc, id, text), whose ids are null or unique, without those that are not kept."""
    drop = cut(near_duplicates(rows, "id", "text").where("not kept").select(F.col("id").alias("gone")).distinct())
    n = drop.count()
    return rows.join(F.broadcast(drop) if n <= 2_000_000 else drop, F.col("id") == F.col("gone"), "left_anti")
