"""Nearest neighbours by stable projections: a kd-tree over a few projected dimensions.

Largest inner product becomes smallest distance by one more coordinate, which gives all candidates
the same norm. Gaussian projections are 2-stable: a pair at distance d is projected to a squared
distance of d^2 times a chi-square variable with `DIMENSION` degrees of freedom. A search takes the
projected points leaf by leaf in the order of their projected distance and verifies them on the
original vectors, until the chi-square chance that a point as near as the k-th found is still
further out in the projection is under 1 - `stop`.

The index holds every row. The upper splits of the kd-tree (the parts) are fitted on about
`sample_rows` rows chosen by a hash of the id; a part of more than `BLOCK` rows is dealt by hash into
blocks, all of which a query visits. A first round searches one block of the query's own part, whose
k-th distance lets the second round skip the parts whose bounding boxes already pass the test.
Points of a block are held once (bounded by BLOCK); queries stream past them.

Equal vectors are one point of the index, with their `k + 1` smallest ids: no other can be among the k
nearest. Matrix products only find candidates; every score that is ranked or returned is one sum over
the pair's own components in a fixed order (`exact`), so equal vectors score alike wherever they lie.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take no part,
as queries or candidates, nor do rows whose id is null; a candidate of another length than the query's is
none; a query's own id is never its neighbour; ties go to the smaller id; fewer than k candidates are all
returned; a row that is repeated counts once; an id that stands on several vectors is a candidate with each and scores by
its nearest, and asks with the first of them in byte order; components of any finite size are
compared after one common shift of their exponents, and a product beyond the doubles scores infinity; an empty table gives an
empty result; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, sample_by_hash

DIMENSION, LEAF, BLOCK = 8, 64, 4096
_SEED = 23


def chi_square_below(x: float, m: int = DIMENSION) -> float:
    """The chance that a chi-square variable with an even number m of degrees of freedom is below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))


def quantile(p: float, m: int = DIMENSION) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_below(mid, m) < p else (lo, mid)
    return hi


class Projection:
    def __init__(self, top: dict[int, float]):
        self.top, self.maps = top, {}  # the largest squared norm for each length

    def _map(self, width: int) -> np.ndarray:
        if width not in self.maps:
            self.maps[width] = np.random.default_rng([_SEED, width]).normal(size=(width + 1, DIMENSION))
        return self.maps[width]

    def points(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(0, self.top[x.shape[1]] - (x * x).sum(1)))
        m = self._map(x.shape[1])
        return x @ m[:-1] + extra[:, None] * m[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self._map(x.shape[1])[:-1]


def split(points: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """Dimension and value of each inner node of a balanced kd-tree, in heap order."""
    nodes: list[tuple[int, float]] = []
    groups = [points]
    for _ in range(levels):
        below = []
        for g in groups:
            if not len(g):
                nodes.append((0, 0.0))
                below += [g, g]
                continue
            d = int((g.max(0) - g.min(0)).argmax())
            v = float(np.median(g[:, d]))
            nodes.append((d, v))
            left = g[:, d] <= v
            below += [g[left], g[~left]]
        groups = below
    return nodes


def part_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of the upper tree, from 0."""
    at = np.zeros(len(points), np.int64)
    if not nodes:
        return at
    dims, vals = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
    for _ in range(int(math.log2(len(nodes) + 1))):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] > vals[at])
    return at - len(nodes)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, each summed alone in one order, whatever rows stand beside it."""
    return np.ascontiguousarray(x * q).sum(1)


class Tree:
    """Leaves of at most LEAF projected points with their boxes, and the original vectors in leaf order.

    ids holds the ids of all points one after the other, `many` of them a point.
    """

    def __init__(self, ids: np.ndarray, many: np.ndarray, x: np.ndarray, p: np.ndarray):
        order, self.ends, stack = [], [0], [np.arange(len(x))]
        while stack:
            g = stack.pop()
            if len(g) <= LEAF:
                order.append(g)
                self.ends.append(self.ends[-1] + len(g))
                continue
            q = p[g]
            by = np.argsort(q[:, (q.max(0) - q.min(0)).argmax()], kind="stable")
            stack += [g[by[len(g) // 2 :]], g[by[: len(g) // 2]]]
        o = np.concatenate(order)
        self.x, self.p, self.many, self.first = x[o], p[o], many[o], (np.cumsum(many) - many)[o]
        self.ids, self.repeated = ids, len(np.unique(ids)) < len(ids)  # an id may stand on several vectors
        self.ends = np.array(self.ends)
        self.rows = [np.arange(a, b) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]
        starts = self.ends[:-1]
        self.low, self.high = np.minimum.reduceat(self.p, starts), np.maximum.reduceat(self.p, starts)

    def search(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray, bound: np.ndarray, top: float, k: int, c: float):
        """For each query: ids, each once, and inner products of up to k nearest within its bound (a squared distance)."""
        gaps = np.zeros((len(p), len(self.rows)))
        for j in range(DIMENSION):
            gaps += np.maximum(0, np.maximum(self.low[None, :, j] - p[:, None, j], p[:, None, j] - self.high[None, :, j])) ** 2
        near = np.argsort(gaps, 1, kind="stable")
        for i in range(len(ids)):
            own = float(x[i] @ x[i])
            kth, base = bound[i], own + top
            rounding = 1e-15 * x.shape[1] * math.sqrt(own * top)  # how far a matrix product can be from exact()
            found_id, found = np.zeros(0, np.int64), np.zeros(0)
            at, step, leaves = 0, 32 if np.isfinite(kth) else 4, near[i]
            while at < len(leaves) and gaps[i, leaves[at]] <= c * kth:
                take = leaves[at : at + step]
                take = take[gaps[i, take] <= c * kth]
                at, step = at + step, step * 2
                rows = np.concatenate([self.rows[t] for t in take])
                if np.isfinite(kth):
                    d = self.p[rows] - p[i]
                    rows = rows[np.einsum("ij,ij->i", d, d) <= c * kth]
                rows = rows[self.x[rows] @ x[i] >= (base - kth) / 2 - rounding]
                if not len(rows):
                    continue
                many = self.many[rows]
                new = self.ids[np.repeat(self.first[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                score, other = np.repeat(exact(self.x[rows], x[i]), many), new != ids[i]
                found_id, found = np.concatenate([found_id, new[other]]), np.concatenate([found, score[other]])
                if len(found) > k or self.repeated:
                    o = np.lexsort((found_id, -found))
                    if self.repeated:
                        o = o[np.sort(np.unique(found_id[o], return_index=True)[1])]
                    found_id, found = found_id[o[:k]], found[o[:k]]
                if len(found) >= k:
                    kth = min(kth, max(0.0, base - 2 * found.min()) * (1 + 1e-12) + 4 * rounding)
            yield found_id, found


def _vectors(col, shift: int = 0) -> list[np.ndarray]:
    out = [np.frombuffer(b.as_buffer(), np.float64) for b in col]
    return [np.ldexp(x, -shift) for x in out] if shift else out


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (the vector's doubles as bytes), width, big (the largest component) of the rows that take part."""

    def run(batches):
        for batch in batches:
            keep, out, width, big = [], [], [], []
            for i, v in enumerate(batch.column(1)):
                if v.is_valid and len(v) and not v.values.null_count:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                    most = float(np.abs(x).max())
                    if np.isfinite(most) and most > 0:
                        keep.append(i)
                        out.append((x + 0.0).tobytes())  # no negative zeros: equal vectors are equal bytes
                        width.append(len(x))
                        big.append(most)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary()), pa.array(width, pa.int32()), pa.array(big, pa.float64())], ["id", "v", "width", "big"])

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    return source.mapInArrow(run, "id long, v binary, width int, big double")


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """v, width, ids: equal vectors once, with their k + 1 smallest ids as the bytes of 64-bit integers.

    The limit within a window is applied before and after the shuffle, so a vector that many rows hold
    sends k + 1 ids from each task.
    """
    few = rows.select("v", "width", "id").withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    by_vector = few.groupBy("v").agg(F.first("width").alias("width"), F.array_sort(F.collect_set("id")).alias("ids"))

    def packed(batches):
        for batch in batches:
            found = [x.values.to_numpy().astype("<i8").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["v", "width", "ids"])

    return by_vector.select("v", "width", "ids").mapInArrow(packed, "v binary, width int, ids binary")


#: ids: of a point all its ids, of a query its own.
_PLACED = "width int, part long, kind int, ids binary, v binary, bound double"
#: Numbers that a task holds at a time while it compares queries with the boxes of the parts.
GAPS = 4_000_000


def nearest_inner_product(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, stop: float = 0.98, sample_rows: int = 20_000, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors."""
    usable = cut(valid(vectors, id_col, vector_col))
    rows, asked = cut(distinct_points(usable, k)), valid(queries, id_col, vector_col)
    asked = cut(asked.groupBy("id").agg(F.min(F.struct("v", "width", "big")).alias("x")).select("id", "x.*"))
    biggest = [df.agg(F.max("big")).first()[0] or 0.0 for df in (usable, asked)]
    shift = math.frexp(max(biggest))[1] if max(biggest) > 0 else 0
    shift = 0 if abs(shift) < 200 else shift
    context = vectors.sparkSession.sparkContext

    def norms(batches):
        for batch in batches:
            n2 = [float(x @ x) for x in _vectors(batch.column(0), shift)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n2, pa.float64())], ["width", "n2"])

    def widths_of(df: DataFrame) -> dict[int, tuple[int, float]]:
        found = df.select("v", "width").mapInArrow(norms, "width int, n2 double").groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("n2").alias("top"))
        return {r["width"]: (r["n"], r["top"]) for r in found.collect()}

    widths, widths_asked = widths_of(rows), widths_of(asked)
    projection = Projection({w: t for w, (_, t) in (widths_asked | widths).items()})
    c = quantile(stop)

    def by_width(batch: pa.RecordBatch):
        width = batch.column(batch.schema.names.index("width")).to_numpy()
        for w in np.unique(width).tolist():
            yield w, batch.take(pa.array(np.flatnonzero(width == w)))

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.array(_vectors(b.column(b.schema.names.index("v")), shift))

    def sampled(batches):
        for batch in batches:
            for w, b in by_width(batch):
                p = projection.points(matrix(b))
                yield pa.RecordBatch.from_arrays([pa.array([w] * len(p), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], ["width", "p"])

    some = sample_by_hash(rows, F.col("v"), sum(n for n, _ in widths.values()), sample_rows, 3).mapInArrow(sampled, "width int, p array<double>").collect()
    nodes = {}
    for w, (n, _) in widths.items():
        pts = np.array([r["p"] for r in some if r["width"] == w]).reshape(-1, DIMENSION)
        nodes[w] = split(pts, min(16, max(0, math.ceil(math.log2(n / (block / 2))))))

    def place(batches):
        for batch in batches:
            for w, b in by_width(batch):
                p = projection.points(matrix(b))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), w, np.int32)), pa.array(part_of(p, nodes[w])), *[pa.array(p[:, i]) for i in range(DIMENSION)]], ["width", "part", *[f"p{i}" for i in range(DIMENSION)]])

    placed = rows.mapInArrow(place, "width int, part long, " + ", ".join(f"p{i} double" for i in range(DIMENSION)))
    boxes = placed.groupBy("width", "part").agg(F.count(F.lit(1)).alias("n"), *[f(f"p{i}").alias(f"{f.__name__}{i}") for i in range(DIMENSION) for f in (F.min, F.max)]).collect()  # 2^16 a width at most
    known = {}
    for w in widths:
        own = sorted((r for r in boxes if r["width"] == w), key=lambda r: r["part"])
        known[w] = (
            np.array([r["part"] for r in own]), np.array([-(-r["n"] // block) for r in own]),
            np.array([[r[f"min{i}"] for i in range(DIMENSION)] for r in own]), np.array([[r[f"max{i}"] for i in range(DIMENSION)] for r in own]),
        )
    shared = context.broadcast((projection, nodes, known))

    def points(batches):
        _, nodes, known = shared.value
        for batch in batches:
            for w, b in by_width(batch):
                part = part_of(projection.points(matrix(b)), nodes[w])
                parts, blocks, *_ = known[w]
                n = blocks[np.minimum(np.searchsorted(parts, part), len(parts) - 1)]
                first = np.array([int.from_bytes(x.as_buffer()[:8].to_pybytes(), "little", signed=True) for x in b.column(b.schema.names.index("ids"))], np.int64)
                h = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield _rows(b, w, part * 65536 + (h % n.astype(np.uint64)).astype(np.int64), 0, np.full(len(part), np.inf))

    def routed(first: bool):
        def run(batches):
            _, _, known = shared.value
            for batch in batches:
                for w, b in by_width(batch):
                    if w not in known:
                        continue
                    for lo in range(0, b.num_rows, max(1, GAPS // len(known[w][0]))):
                        yield from sent(b.slice(lo, max(1, GAPS // len(known[w][0]))), w, known[w])

        def sent(b: pa.RecordBatch, w: int, boxes: tuple):
            p, (parts, blocks, low, high) = projection.queries(matrix(b)), boxes
            gap = np.zeros((len(p), len(parts)))
            for i in range(DIMENSION):
                gap += np.maximum(0, np.maximum(low[None, :, i] - p[:, None, i], p[:, None, i] - high[None, :, i])) ** 2
            if first:
                q, at, block_of = np.arange(len(p)), gap.argmin(1), np.zeros(len(p), np.int64)
                bound = np.full(len(p), np.inf)
            else:
                limit = b.column(b.schema.names.index("bound")).to_numpy()
                q, at = np.nonzero(gap <= c * limit[:, None])
                times = blocks[at]
                q, at = np.repeat(q, times), np.repeat(at, times)
                block_of = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                bound = limit[q]
            for lo in range(0, len(q), 4096):
                part = slice(lo, lo + 4096)
                yield _rows(b.take(pa.array(q[part])), w, parts[at[part]] * 65536 + block_of[part], 1, bound[part])

        return run

    def _rows(b: pa.RecordBatch, w: int, part: np.ndarray, kind: int, bound: np.ndarray) -> pa.RecordBatch:
        n = len(part)
        ids, v = (b.column(b.schema.names.index(x)) for x in ("ids", "v"))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, w, np.int32)), pa.array(part), pa.array(np.full(n, kind, np.int32)), ids, v, pa.array(bound)], ["width", "part", "kind", "ids", "v", "bound"])

    def searched(batches):
        last, ids, vs, tree = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(3)]
            change = np.zeros(batch.num_rows - 1, bool)
            for x in cols:
                change |= x[1:] != x[:-1]
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                w, part, kind = (int(x[a]) for x in cols)
                if (w, part) != last:
                    last, ids, vs, tree = (w, part), [], [], None
                some = batch.slice(a, b - a)
                of = [np.frombuffer(x.as_buffer(), "<i8") for x in some.column(3)]
                if kind == 0:
                    ids += of
                    vs += _vectors(some.column(4), shift)
                    continue
                if not vs:
                    continue
                if tree is None:
                    x = np.array(vs)
                    tree, vs = Tree(np.concatenate(ids), np.array([len(i) for i in ids]), x, projection.points(x)), vs[:1]
                for lo in range(0, some.num_rows, 256):
                    piece = some.slice(lo, 256)
                    q, bound, qid = matrix(piece), piece.column(5).to_numpy(), np.concatenate(of[lo : lo + 256])
                    out = list(tree.search(qid, q, projection.queries(q), bound, projection.top[w], k, c))
                    base = (q * q).sum(1) + projection.top[w]
                    n = [len(f) for f, _ in out]
                    whose = np.repeat(np.arange(len(n)), n)
                    score = np.concatenate([s for _, s in out])
                    d2 = np.maximum(0, base[whose] - 2 * score)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[whose]), pa.array(np.concatenate([f for f, _ in out])), pa.array(score), pa.array(d2)], ["query_id", "vec_id", "score", "d2"])

    def meet(q: DataFrame) -> DataFrame:
        both = rows.mapInArrow(points, _PLACED).union(q)
        return both.repartition("width", "part").sortWithinPartitions("width", "part", "kind").mapInArrow(searched, "query_id long, vec_id long, score double, d2 double")

    asked = asked.select("id", _packed_id(F.col("id")).alias("ids"), "v", "width")
    near = cut(meet(asked.drop("id").mapInArrow(routed(True), _PLACED)))
    bounds = near.groupBy("query_id", "vec_id").agg(F.min("d2").alias("d2")).groupBy("query_id").agg(F.max("d2").alias("d2"), F.count(F.lit(1)).alias("n"))
    slack = 1e-9 * max([t for _, t in widths.values()] or [0.0])
    bounds = bounds.select("query_id", F.when(F.col("n") >= k, F.col("d2") * (1 + 1e-9) + slack).otherwise(F.lit(float("inf"))).alias("bound"))
    limited = asked.join(bounds, F.col("id") == F.col("query_id"), "left").select("ids", "v", "width", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    # what set a query's bound may itself lie beyond the test's reach in the second round
    found = meet(limited.mapInArrow(routed(False), _PLACED)).unionByName(near)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", (F.col("score") * F.lit(2.0**shift) * F.lit(2.0**shift) if shift else F.col("score")).alias("score"))


def _packed_id(i: Column) -> Column:
    """The eight bytes of an id, the lowest first."""
    big = F.lpad(F.hex(i), 16, "0")
    return F.unhex(F.concat(*[F.substr(big, F.lit(15 - 2 * j), F.lit(2)) for j in range(8)]))
