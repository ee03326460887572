"""Near-duplicate vectors by E8 lattice hashing.

Unit vectors are projected to eight dimensions by a random matrix for each table, shifted, and decoded
to the nearest point of the E8 lattice: the vector's home cell. It also probes the lattice points
nearest to it among the home cell's 240 neighbours. Vectors that meet in a cell, at least one of
them at home, are compared by their cosine in double precision; so a link is never wrong, and one is
missed only if its vectors meet in no table (under 0.1 % for a cosine of 0.95 at the defaults, less above).

Equal vectors are one class throughout. A crowded cell is dealt by hash into blocks, and pairs of
blocks are compared in tasks of their own, so no task holds more than about two blocks (of 2 MB of vectors each: a row of a cell of
n rows is copied n / 4096 times where vectors have 64 dimensions). A task
returns a count for each vector and a spanning forest of its links, not the links. A pair that meets
several times is counted once: at its first table and, there, in the smaller of its two cells, which
each task finds out by hashing its own vectors again.

Defined results: vectors that are null, zero or hold null or non-finite components link with
nothing; a row without an id is left out of the links and components of others, has a null component and is kept; vectors of different lengths never meet; equal vectors link; repeated rows each give a row,
and link if their ids differ in nothing but their row; an empty table gives an empty result;
other columns are ignored.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .components import components
from .shingles import U, mix

#: Bytes of the vectors of one block of a crowded cell, and rows that are compared with others at a time.
BLOCK_BYTES, BLOCK = 2 << 20, 512


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number negative."""
    pairs = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(y)
    d = y - r
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    k = np.abs(d[odd]).argmax(1)
    r[odd, k] += np.where(d[odd, k] >= 0, 1.0, -1.0)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: the better of the even integer point and the even half-integer point."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    """A 63-bit key of lattice points (their doubled coordinates are integers)."""
    c = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    h = np.full(points.shape[:-1], U(table + 1), np.uint64)
    for k in range(8):
        h = mix(h * U(0x9E3779B97F4A7C15) + c[..., k])
    return (h >> U(1)).astype(np.int64)


class Lattice:
    """The tables: what cells a unit vector of `width` numbers lives in and probes."""

    def __init__(self, tables: int = 4, probes: int = 4, cell: float = 1.5, seed: int = 11):
        self.tables, self.probes, self.cell, self.seed = tables, probes, cell, seed
        self.roots, self.maps = roots(), {}

    def _map(self, dim: int, table: int):
        if (dim, table) not in self.maps:
            rng = np.random.default_rng([self.seed, dim, table])
            self.maps[dim, table] = rng.normal(size=(dim, 8)) / self.cell, rng.uniform(0, 2, 8)
        return self.maps[dim, table]

    def cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the home cells (n) and of the probed ones (n x probes)."""
        m, shift = self._map(x.shape[1], table)
        y = x @ m + shift
        home = nearest(y)
        near = (y - home) @ self.roots.T
        best = np.argsort(-near, 1, kind="stable")[:, : self.probes]
        return _key(home, table), _key(home[:, None, :] + self.roots[best], table)


def unit(batch: pa.RecordBatch, place: int) -> list[np.ndarray | None]:
    """The usable vectors as unit vectors in double precision, None for the others."""
    out: list[np.ndarray | None] = []
    for v in batch.column(place):
        x = None
        if v.is_valid and len(v) and not v.values.null_count:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            big = np.abs(x).max()
            x = x / big / np.linalg.norm(x / big) if np.isfinite(big) and big > 0 else None
        out.append(x)
    return out


def _by_width(ids: list, vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for w in {len(v) for v in vectors}:
        at = [i for i, v in enumerate(vectors) if len(v) == w]
        out.append((np.array(at), np.array([vectors[i] for i in at])))
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y:
            parent[x] = y
            out.append((i, j))
    return out


def _compare(lattice: Lattice, table: int, ids, mult, side, role, vectors, cell: int, cross: bool, least: float):
    """Links of one block or pair of blocks of a cell: counts for each row, and forest edges."""
    n = len(ids)
    counts = np.zeros(n, np.int64)
    edges: list[tuple[int, int]] = []
    for at, x in _by_width(ids, vectors):
        if len(at) < 2 or not (role[at] == 0).any():
            continue
        keys = None
        for lo in range(0, len(at), BLOCK):
            s = x[lo : lo + BLOCK] @ x.T
            i, j = np.nonzero(s >= least)
            i += lo
            gi, gj = at[i], at[j]
            keep = (gi < gj) & ((role[gi] == 0) | (role[gj] == 0))
            if cross:
                keep &= side[gi] != side[gj]
            i, j, gi, gj = i[keep], j[keep], gi[keep], gj[keep]
            keep = ids[gi] != ids[gj]
            i, j, gi, gj = i[keep], j[keep], gi[keep], gj[keep]
            if not len(i):
                continue
            edges += _forest(gi, gj, n)
            if keys is None:
                keys = [lattice.cells(x, t) for t in range(table + 1)]
            new = np.ones(len(i), bool)
            for t in range(table):
                home, probe = keys[t]
                new &= ~((home[i] == home[j]) | (probe[i] == home[j][:, None]).any(1) | (probe[j] == home[i][:, None]).any(1))
            home, probe = keys[table]
            # Here the pair meets at home[i], at home[j] or at both: it counts at the smaller of those where it meets.
            same = home[i] == home[j]
            at_j, at_i = (probe[i] == home[j][:, None]).any(1), (probe[j] == home[i][:, None]).any(1)
            first = np.where(at_i & at_j, np.minimum(home[i], home[j]), np.where(at_i, home[i], home[j]))
            new &= same | (first == cell)
            np.add.at(counts, gi[new], mult[gj[new]])
            np.add.at(counts, gj[new], mult[gi[new]])
    return counts, edges


def _pairs_schema() -> str:
    return "edge boolean, a long, b long"


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int = 4, probes: int = 4, cell: float = 1.5, block: int | None = None
) -> DataFrame:
    """id_col, n_links, component_id and kept of each row. block: rows of a block, else as BLOCK_BYTES allows."""
    lattice = Lattice(tables, probes, cell)

    def units(batches):
        for batch in batches:
            found = [None if x is None else (x + 0.0).tobytes() for x in unit(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "v"])

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = cut(source.mapInArrow(units, "id long, v binary"))
    classes = cut(rows.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult")))
    if block is None:
        longest = classes.agg(F.max(F.octet_length("v"))).first()[0] or 8
        block = max(256, min(8192, BLOCK_BYTES // longest))

    def keys_only(batches):
        for table, cells, *_ in _cells(batches, lattice):
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(cells, pa.int64())], ["t", "cell"])

    crowded = classes.select("rep", "mult", "v").mapInArrow(keys_only, "t int, cell long").groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n"))
    crowded = cut(crowded.where(F.col("n") > block).select("t", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    n_crowded = crowded.count()

    def placed(batches):
        for table, cells, role, rep, mult, v in _cells(batches, lattice):
            cols = [pa.array(table, pa.int32()), pa.array(cells, pa.int64()), pa.array(role, pa.int8()), rep, mult, v]
            yield pa.RecordBatch.from_arrays(cols, ["t", "cell", "role", "rep", "mult", "v"])

    met = classes.select("rep", "mult", "v").mapInArrow(placed, "t int, cell long, role tinyint, rep long, mult long, v binary")
    met = met.join(F.broadcast(crowded) if n_crowded <= 200_000 else crowded, ["t", "cell"], "left")
    own = F.pmod(F.xxhash64("rep", "role"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), (own > o).cast("tinyint").alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("tinyint").alias("side")))
    met = met.withColumn("to", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(others)))
    met = met.select("t", "cell", "role", "rep", "mult", "v", "to.*")
    dealt = met.repartition("t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j")

    def compare(batches):
        for key, part in _groups(batches):
            role = part["role"].to_numpy()
            if len(role) < 2 or role.all():
                continue
            ids, mult, side = part["rep"].to_numpy(), part["mult"].to_numpy(), part["side"].to_numpy()
            vs = [np.frombuffer(b.as_buffer(), np.float64) for b in part["v"]]
            counts, edges = _compare(lattice, key[0], ids, mult, side, role, vs, key[1], key[2] != key[3], least)
            at = np.flatnonzero(counts)
            a = np.concatenate([ids[at], ids[[e[0] for e in edges]] if edges else ids[:0]])
            b = np.concatenate([counts[at], ids[[e[1] for e in edges]] if edges else ids[:0]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)) >= len(at)), pa.array(a), pa.array(b)], ["edge", "a", "b"])

    found = cut(dealt.mapInArrow(compare, _pairs_schema()))
    links = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    group = components(found.where("edge").select("a", "b"))
    info = classes.join(links, "rep", "left").join(group, F.col("rep") == F.col("node"), "left")
    info = cut(info.select("v", (F.coalesce("linked", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    named = rows.select("id", F.when(F.col("id").isNotNull(), F.col("v")).alias("v"))
    out = named.join(info, "v", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _cells(batches, lattice: Lattice):
    """For each table: table, cell, role (0 at home, 1 probing), rep, mult and vector of every row."""
    for batch in batches:
        vs = [np.frombuffer(b.as_buffer(), np.float64) for b in batch.column(2)]
        for at, x in _by_width([], vs):
            for table in range(lattice.tables):
                home, probe = lattice.cells(x, table)
                cells = np.concatenate([home[:, None], probe], 1)
                k = cells.shape[1]
                rows = batch.take(pa.array(np.repeat(at, k)))
                role = np.tile((np.arange(k) > 0).astype(np.int8), len(at))
                yield np.full(len(role), table, np.int32), cells.ravel(), role, rows.column(0), rows.column(1), rows.column(2)


def _groups(batches, keys: tuple[str, ...] = ("t", "cell", "i", "j")):
    """Whole groups of sorted rows; a group's size is bounded by how its rows were dealt."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t[k].to_numpy() for k in keys]
        change = np.zeros(t.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield last, pa.concat_tables(held).combine_chunks()
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield last, pa.concat_tables(held).combine_chunks()
