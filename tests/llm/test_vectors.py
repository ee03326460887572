import collections

import numpy as np
import pytest

from tidepool.llm import components, lattice_dedup, projected_search

ODD = [None, [], [0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1.0, 2.0]]


def frame(spark, x, extra=()):
    rows = [(int(i), [float(np.float32(a)) for a in v], "c", "d") for i, v in enumerate(x)]
    rows += [(10_000 + i, v, "c", "d") for i, v in enumerate(extra)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, rep string").repartition(3)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):  # a near copy, some of them just at the threshold
        z = rng.normal(size=dim)
        u = x[i] / np.linalg.norm(x[i])
        z -= (z @ u) * u
        c = rng.uniform(0.93, 0.999)
        x[(i + 1) % n] = 3 * (c * u + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("block", [512, 20])
def test_near_duplicate_vectors(spark, block):
    x = clustered(300, 32, 1)
    x[200:260] = x[200] + 0.01 * np.random.default_rng(2).normal(size=(60, 32))
    x[270:275] = x[270]
    x = x.astype(np.float32).astype(float)
    got = {r["vec_id"]: r for r in lattice_dedup.near_duplicates(frame(spark, x, ODD), block=block).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    link = (s >= 0.95) & ~np.eye(len(x), dtype=bool)
    assert len(got) == len(x) + len(ODD)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found <= link.sum() and found >= 0.99 * link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    assert {got[i]["component_id"] for i in range(200, 260)} == {min(got[i]["component_id"] for i in range(200, 260))}
    for i in range(len(ODD) - 1):
        r = got[10_000 + i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (0, 10_000 + i, True)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_repeated_and_empty(spark):
    x = np.eye(4)
    df = frame(spark, x).union(frame(spark, x[:1]))
    rows = lattice_dedup.near_duplicates(df).collect()
    assert collections.Counter((r["vec_id"], r["n_links"]) for r in rows) == {(0, 1): 2, (1, 0): 1, (2, 0): 1, (3, 0): 1}
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_without_an_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (3, [1.0, 0.01])], "vec_id long, embedding array<double>")
    rows = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in lattice_dedup.near_duplicates(df).collect())
    assert rows == [("0", 1, 0, True), ("3", 1, 0, False), ("None", 0, None, True), ("None", 0, None, True)]


def test_lattice_decodes_to_the_nearest_point():
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, (200, 8))
    near = lattice_dedup.nearest(x)
    far = ((x - near) ** 2).sum(1)
    assert far.max() <= 1 + 1e-9  # the covering radius
    for r in lattice_dedup.roots():
        assert (((x - near - r) ** 2).sum(1) >= far - 1e-9).all()
    assert len({tuple(r) for r in lattice_dedup.roots()}) == 240


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {i: top(i) for i in root if top(i) != i}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chi_square():
    assert projected_search.chi_square_below(projected_search.quantile(0.95)) == pytest.approx(0.95)
    assert projected_search.quantile(0.95) == pytest.approx(15.507, abs=1e-3)  # 8 degrees of freedom


@pytest.mark.parametrize("block", [8192, 50])
def test_nearest_inner_products(spark, block):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 16)) * rng.uniform(0.5, 2, (400, 1))).astype(np.float32).astype(float)
    x[50:60] = x[50]  # ties
    df = frame(spark, x, ODD)
    rows = projected_search.nearest_inner_product(df, df.where("vec_id % 20 = 0"), block=block).collect()
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    hit = 0
    assert set(by) == set(range(0, 400, 20))
    for q, found in by.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        hit += len({r["vec_id"] for r in found} & set(order))
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(r["score"] == float(projected_search.exact(x[r["vec_id"]][None], x[q])[0]) for r in found)  # to the last bit
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in found)
        assert all((a["score"], -a["vec_id"]) >= (b["score"], -b["vec_id"]) for a, b in zip(found, found[1:]))
    assert hit >= 0.95 * 20 * len(by)


def test_few_candidates(spark):
    df = frame(spark, np.eye(4)[:3] + 1, ODD)
    rows = projected_search.nearest_inner_product(df, df.where("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in rows) == [(0, 1), (0, 2)]
    assert projected_search.nearest_inner_product(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 50])
def test_repeated_candidates_push_out_none(spark, block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 16)).astype(np.float32).astype(float)
    near = 3 * x[0]
    df = frame(spark, x)
    copies = spark.createDataFrame([(500, near.tolist(), "c", "d")] * 45 + [(501, (near * (1 + i / 100)).tolist(), "c", "d") for i in range(45)], df.schema)
    rows = projected_search.nearest_inner_product(df.union(copies).repartition(3), df.where("vec_id = 0"), block=block, stop=0.999999).collect()
    s = {i: float(x[i] @ x[0]) for i in range(1, 200)} | {500: float(near @ x[0]), 501: float(near @ x[0]) * 1.44}
    want = sorted(s, key=lambda i: (-s[i], i))[:20]
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])] == want and want[:2] == [501, 500]


@pytest.mark.parametrize("block", [8192, 16])
@pytest.mark.parametrize("copies", [21, 64])
def test_tied_candidates_come_by_id_with_one_score(spark, block, copies):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24))
    x[100 : 100 + copies] = 2.5 * x[0] + 0.1  # all nearer to row 0 than any other row
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 3 + [(None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = set()
    for parts in (1, 5):
        found = projected_search.nearest_inner_product(df.repartition(parts), df.where("vec_id in (0, 100, 7)"), block=block).collect()
        by = collections.defaultdict(list)
        for r in sorted(found, key=lambda r: r["rank"]):
            by[r["query_id"]].append((r["vec_id"], r["score"]))
        assert [i for i, _ in by[0]] == list(range(100, 120)) and len({s for _, s in by[0]}) == 1
        assert [i for i, _ in by[100]] == list(range(101, 121)) and all(len(v) == 20 for v in by.values())
        seen.add(tuple(by[0]))
    assert len(seen) == 1


def test_components_of_any_size_take_part(spark):
    for big in (1e200, 1e-200):
        x = (np.eye(5) + 1) * 2.0 ** round(np.log2(big))  # sums of whole numbers: exact ties
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        rows = projected_search.nearest_inner_product(df, df.where("vec_id = 0")).collect()
        assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3, 4] and all(r["score"] == (float("inf") if big > 1 else 0.0) for r in rows)


def test_an_id_on_several_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.5, 0.0]), (0, [0.5, 0.0])], "vec_id long, embedding array<double>")
    rows = {(r["query_id"], r["vec_id"], r["score"]) for r in projected_search.nearest_inner_product(df.repartition(3), df.where("vec_id = 0")).collect()}
    v = min((np.array(a) + 0.0 for a in ([1.0, 0.0], [0.5, 0.0])), key=lambda a: a.tobytes())[0]
    assert rows == {(0, 1, 2.0 * v), (0, 2, 1.5 * v)}
