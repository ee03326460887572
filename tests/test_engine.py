import random

import pytest
from pyspark.sql import functions as F

from tidepool.functions import atomics
from tidepool.operators import allocator, conflicts, directory, folds, overlay, ranges, routing, selectors, store
from tidepool.plans.transactions import Aborted, Rollback, Transaction, coalesced, transact
from tidepool.sources import log as logs, tools
from tidepool.sources.objects import Objects
from tidepool.sources.snapshots import Snapshots, compacted


def kv(spark, rows):
    return spark.createDataFrame([(bytearray(k), v, None if x is None else bytearray(x)) for k, v, x in rows], "key binary, version long, value binary")


LOG = [(b"j", 1, b"d"), (b"n", 1, b"1"), (b"a", 1, None), (b"c", 1, b"c"), (b"n", 2, None), (b"a", 2, b"b"), (b"c", 3, b"x")]


def state(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


def test_reads_at_versions(spark):
    t = kv(spark, LOG)
    assert state(store.latest(t, 1)) == {b"j": b"d", b"n": b"1", b"c": b"c"}
    assert state(store.latest(t, 2)) == {b"j": b"d", b"a": b"b", b"c": b"c"}
    assert state(store.latest(t)) == {b"j": b"d", b"a": b"b", b"c": b"x"}
    with pytest.raises(store.VersionError, match="too_new"):
        store.kv_at(t, 9, newest=3)
    with pytest.raises(store.VersionError, match="too_old"):
        store.kv_at(t, 0, oldest=1)


def test_retention_keeps_every_later_read(spark):
    t = kv(spark, LOG)
    kept = store.retain(t, 2)
    for v in (2, 3):
        assert state(store.latest(kept, v)) == state(store.latest(t, v))
    assert kept.count() < t.count()


def test_empty_store(spark):
    t = kv(spark, LOG).limit(0)
    assert state(store.latest(t)) == {} and store.page(store.latest(t), b"a", b"z", 3).count() == 0


def test_pages(spark):
    t = store.latest(kv(spark, LOG))
    rows = store.page(t, b"a", b"z", 2).collect()
    assert [bytes(r["key"]) for r in rows] == [b"a", b"c"] and all(r["has_more"] for r in rows)
    assert not any(r["has_more"] for r in store.page(t, b"a", b"z", 3).collect())


@pytest.mark.parametrize("ranges_", [1, 4, 256])
def test_selectors_against_sorted_list(spark, ranges_):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(1000), 120))
    kinds = {
        "first_greater_or_equal": lambda p: sum(k < p for k in keys), "first_greater_than": lambda p: sum(k <= p for k in keys),
        "last_less_or_equal": lambda p: sum(k <= p for k in keys) - 1, "last_less_than": lambda p: sum(k < p for k in keys) - 1,
    }
    probes = [(rng.randrange(-5, 1010), k, rng.randrange(-3, 4)) for k in kinds for _ in range(40)]
    found = selectors.resolve(spark.createDataFrame([(k,) for k in keys], "key long"), spark.createDataFrame(probes, "probe long, kind string, offset int").distinct(), ranges_)
    for r in found.collect():
        at = kinds[r["kind"]](r["probe"]) + r["offset"]
        assert r["found"] == (keys[at] if 0 <= at < len(keys) else None)


def test_scalar_selectors(spark):
    rows = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"c", b"e")], "key binary")
    one = lambda s: next((bytes(r["key"]) for r in selectors.scalar(rows, s).collect()), None)
    assert one(selectors.first_greater_or_equal(b"c")) == b"c" and one(selectors.first_greater_or_equal(b"b")) == b"c"
    assert one(selectors.first_greater_than(b"c")) == b"e" and one(selectors.first_greater_than(b"b")) == b"c"
    assert one(selectors.last_less_or_equal(b"c")) == b"c" and one(selectors.last_less_or_equal(b"d")) == b"c"
    assert one(selectors.last_less_than(b"c")) == b"a" and one(selectors.last_less_than(b"a")) is None
    assert one(selectors.first_greater_or_equal(b"a").add(2)) == b"e" and one(selectors.first_greater_than(b"e")) is None


def test_general_folds_against_model(spark):
    rng = random.Random(5)
    rows, model = [], {}
    for v in range(300):
        k, op = f"k{rng.randrange(8)}", rng.choice([*atomics.NAMES, "set", "clear"])
        operand = bytes(rng.randrange(256) for _ in range(rng.randrange(4)))
        rows.append((k, v, 0, 0, op, bytearray(operand)))
        old = model.get(k)
        model[k] = operand if op == "set" else None if op == "clear" else atomics.apply(op, old, operand)
    df = spark.createDataFrame(rows, "key string, version long, txn int, seq int, op string, operand binary")
    got = {r["key"]: None if r["value"] is None else bytes(r["value"]) for r in folds.general(df).collect()}
    assert got == model


def test_append_stops_at_the_limit(spark):
    df = spark.createDataFrame([("k", i, 0, 0, bytearray(b"abc")) for i in range(5)], "key string, version long, txn int, seq int, operand binary")
    assert bytes(folds.append_if_fits(df, 10).first()["value"]) == b"abcabcabc"


def test_supersession(spark):
    rows = [(1, 1, 0, "add", 5, None, "a"), (1, 1, 1, "add", 5, None, "b"), (1, 1, 2, "clear_range", 0, 4, None), (1, 1, 3, "set", 2, None, "c"), (1, 1, 1, "set", 3, None, "gone")]
    df = spark.createDataFrame(rows, "version long, txn int, seq int, op string, key long, end_key long, operand string")
    got = sorted((r["op"], r["key"], r["operand"]) for r in folds.superseded(df).collect())
    assert got == [("add", 5, "b"), ("clear_range", 0, None), ("set", 2, "c")]


def test_ranges_against_points(spark):
    rng = random.Random(7)
    rs = [(rng.randrange(100), rng.randrange(1, 12)) for _ in range(40)]
    df = spark.createDataFrame([(1, i, s, s + n) for i, (s, n) in enumerate(rs)], "g int, id int, s long, e long")
    points = {p for s, n in rs for p in range(s, s + n)}
    merged = ranges.coalesce_ranges(df, ["g"]).collect()
    assert {p for r in merged for p in range(r["s"], r["e"])} == points
    assert not any(a["e"] >= b["s"] for a, b in zip(sorted(merged, key=lambda r: r["s"]), sorted(merged, key=lambda r: r["s"])[1:]))
    for r in ranges.segments(df, ["g"], "id").collect():
        assert r["members"] == sorted(i for i, (s, n) in enumerate(rs) if s < r["e"] and r["s"] < s + n)
    two = df.select("g", F.col("id").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    for grid in (None, 1, 7, 1000):
        got = sorted((r["id"], r["j"]) for r in ranges.overlap_join(df, two, ["g"], ("s", "e"), ("s2", "e2"), grid).collect())
        assert got == sorted((i, j) for i, (s, n) in enumerate(rs) for j, (t, m) in enumerate(rs) if s < t + m and t < s + n)


def test_clear_range_end_is_exclusive(spark):
    sets = spark.createDataFrame([(i, 1000, f"v{i}") for i in range(1, 21)], "k long, version long, value string")
    clears = spark.createDataFrame([(5, 15, 1100), (1, 2, 900)], "s long, e long, at long")
    assert sorted(r["k"] for r in ranges.apply_clears(sets, clears).collect()) == [1, 2, 3, 4, *range(15, 21)]


def test_greedy_resolution_against_model(spark):
    rng = random.Random(11)
    txns = [(t, t // 20) for t in range(100)]
    reads = [(t, t - rng.randrange(1, 30), t, s := rng.randrange(30), s + rng.randrange(1, 4)) for t, _ in txns]
    writes = [(t, t, s := rng.randrange(30), s + rng.randrange(1, 4)) for t, _ in txns]
    r = spark.createDataFrame(reads, "txn long, read_version long, version long, s long, e long")
    w = spark.createDataFrame(writes, "txn long, version long, s long, e long")
    want = {(a[0], b[0]) for a in reads for b in writes if a[1] < b[1] < a[2] and a[3] < b[3] and b[2] < a[4]}
    for lag in (None, 30):
        assert {(x["reader"], x["writer"]) for x in conflicts.pairs(r, w, 8, lag).collect()} == want
    ok = {}
    for t, _ in txns:  # a conflict with an accepted transaction of an earlier batch counts as well
        ok[t] = not any(x == t and ok.get(y) for x, y in want)
    assert any(not ok[x] and y // 20 < x // 20 and all(z // 20 < x // 20 for w_, z in want if w_ == x and ok[z]) for x, y in want)
    found = spark.createDataFrame(sorted(want), "reader long, writer long")
    for few in (10**6, 40, 0):
        got = {x["txn"]: x["accepted"] for x in conflicts.resolve(spark.createDataFrame(txns, "txn long, batch long"), found, few).collect()}
        assert got == ok
    assert all(x["accepted"] for x in conflicts.resolve(spark.createDataFrame(txns, "txn long, batch long"), found.limit(0)).collect())


def test_binary_conflicts_against_model(spark):
    rng = random.Random(12)
    key = lambda: bytes(rng.choice(b"\x00\x01a\xfe\xff") for _ in range(rng.randrange(0, 10)))
    start = b"p" * 9

    def pair():
        s = start + key()
        return bytearray(s), bytearray(s + b"\x00" if rng.random() < 0.4 else max(s + b"\x00", start + key()))

    reads = [(t, t - rng.randrange(1, 20), t, *pair()) for t in range(80)]
    writes = [(t, t, *pair()) for t in range(80)]
    r = spark.createDataFrame(reads, "txn long, read_version long, version long, s binary, e binary")
    w = spark.createDataFrame(writes, "txn long, version long, s binary, e binary")
    want = {(a[0], b[0]) for a in reads for b in writes if a[1] < b[1] < a[2] and a[3] < b[3] and b[2] < a[4]}
    for lag in (None, 20):
        assert {(x["reader"], x["writer"]) for x in conflicts.pairs(r, w, lag=lag).collect()} == want
    point = lambda x: x[-1] == x[-2] + b"\x00"
    assert {(x["reader"], x["writer"]) for x in conflicts.point_pairs(r, w).collect()} == {(a[0], b[0]) for a in reads for b in writes if a[1] < b[1] < a[2] and point(a) and point(b) and a[3] == b[2]}
    m = conflicts.metrics(r, w).first()
    assert m["points"] == sum(map(point, writes)) and m["ranges"] == 80 - m["points"]
    shards = [(0, start + b"\x01"), (1, start + b"a\x00"), (2, start + b"\xff"), (3, b"q")]
    map_ = routing.with_starts(spark.createDataFrame([(t, bytearray(e)) for t, e in shards], "tag int, end binary"), bytearray(b""))
    cut = conflicts.sharded(w, map_).collect()
    for t, _, s, e in writes:
        parts = sorted((bytes(x["s"]), bytes(x["e"])) for x in cut if x["txn"] == t)
        assert parts[0][0] == s and parts[-1][1] == e and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    by = {bytes(x["s"]): x["tag"] for x in routing.lookup(w.select("s").distinct(), "s", shards).collect()}
    more = [(i, bytes([i])) for i in range(100)] + [(200 + t, e) for t, e in shards]
    for got, ends in ((by, shards), ({bytes(x["s"]): x["tag"] for x in routing.lookup(w.select("s").distinct(), "s", more).collect()}, more)):
        assert got == {bytes(s): next((t for t, e in sorted(ends, key=lambda x: x[1]) if s < e), None) for _, _, s, _ in writes}
    d = conflicts.refused_by_any(spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, True)], "txn long, tag int, accepted boolean"))
    assert {x["txn"]: x["accepted"] for x in d.collect()} == {1: False, 2: True}


def test_wide_and_narrow_ranges_meet_without_a_nested_loop(spark):
    rng = random.Random(13)
    make = lambda n: [(i, s := rng.choice([rng.randrange(-(2**61), 2**61), rng.randrange(1000)]), s + rng.choice([1, 3, 10**6, 2**60])) for i in range(n)]
    a, b = make(60), make(60)
    one, two = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, t long, f long")
    met = ranges.overlap_join(one, two, [], ("s", "e"), ("t", "f"))
    assert sorted((x["i"], x["j"]) for x in met.collect()) == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "CartesianProduct" not in met._jdf.queryExecution().toString()
    inside = ranges.covering(one, two, "s", s="t", e="f")
    assert sorted((x["i"], x["j"]) for x in inside.collect()) == sorted((x[0], y[0]) for x in a for y in b if y[1] <= x[1] < y[2])


def test_a_resolver_parks_what_lacks_a_predecessor(spark):
    rows = spark.createDataFrame([(3, 5), (5, 9), (9, 10), (11, 12), (12, 13), (2, 4)], "last_version long, version long")
    got = {x["version"]: x["state"] for x in conflicts.in_sequence(rows, 3).collect()}
    assert got == {5: "ready", 9: "ready", 10: "ready", 12: "parked", 13: "parked", 4: "stale"}


def test_overlay_and_counts(spark):
    s = "key long, value string"
    base = spark.createDataFrame([(i, f"b{i}") for i in range(6)], s)
    pending = spark.createDataFrame([(1, None), (3, "new"), (9, "add")], s)
    cleared = spark.createDataFrame([(2, 5)], "s long, e long")
    after = overlay.merged(base, pending, cleared)
    assert sorted(map(tuple, after.collect())) == [(0, "b0"), (3, "new"), (5, "b5"), (9, "add")]
    assert tuple(overlay.mutation_counts(base, after).first()) == (1, 3, 1)


def test_clamping_covers_without_overlap(spark):
    shards = routing.with_starts(spark.createDataFrame([(0, 10), (1, 25), (2, 100)], "tag int, end long"), 0)
    df = spark.createDataFrame([(1, 5, 30), (2, 10, 11), (3, 0, 100)], "id int, s long, e long")
    rows = routing.clamp(df, shards).collect()
    for i, s, e in ((1, 5, 30), (2, 10, 11), (3, 0, 100)):
        assert sorted(p for r in rows if r["id"] == i for p in range(r["s"], r["e"])) == list(range(s, e))


def test_directories(spark):
    t = spark.createDataFrame([], "path array<string>, prefix binary, layer string")
    t = directory.create(t, ["a"], b"\x01")
    t = directory.create(t, ["a", "b"], b"\x02", "partition")
    for call, error in (
        (lambda: directory.create(t, ["a"], b"\x09"), "already_exists"), (lambda: directory.create(t, ["x", "y"], b"\x09"), "parent"),
        (lambda: directory.create(t, ["c"], b"\x02\x05"), "collision"), (lambda: directory.create(t, [], b"\x09"), "root"), (lambda: directory.moved(t, ["a"], ["a", "b", "c"]), "subdirectory"),
        (lambda: directory.open_(t, ["z"]), "does_not_exist"), (lambda: directory.validate([".."]), "invalid"), (lambda: directory.check_version((2, 0, 0), False), "incompatible"),
        (lambda: directory.check_version((1, 1, 0), True), "restricted"),
    ):
        with pytest.raises(directory.DirectoryError, match=error):
            call()
    assert [r["name"] for r in directory.children(t, ["a"]).collect()] == ["b"]
    assert directory.open_(t, ["a", "b"]).first()["partition"]
    m = directory.moved(t, ["a"], ["n"])
    assert sorted(tuple(r["path"]) for r in m.collect()) == [("n",), ("n", "b")]
    assert directory.removed(m, ["n"]).count() == 0
    assert directory.create_or_open(t, ["a"], b"\x07").count() == 2


def test_transactions(spark):
    base = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1")), (bytearray(b"c"), bytearray(b"3"))], "key binary, value binary")
    tx = Transaction(base)
    tx.put(b"b", b"2")
    assert tx.get(b"a") == b"1" and tx.get(b"b") == b"2" and tx.get(b"zz") is None
    assert (b"zz", b"zz\x00") in tx.read_conflicts
    n = len(tx.read_conflicts)
    tx.get(b"c", snapshot=True)
    assert len(tx.read_conflicts) == n
    tx.clear_range(b"a", b"c")
    assert tx.get(b"a") is None and tx.get(b"b") is None
    tx.put(b"b", b"9")
    assert [(bytes(r["key"]), bytes(r["value"])) for r in tx.get_range(b"a", snapshot=True).collect()] == [(b"b", b"9"), (b"c", b"3")]
    tx.atomic("add", b"n", b"\x05")
    tx.atomic("add", b"n", b"\x0a")
    assert [m for m in tx.mutations if m[1] == b"n"] == [("add", b"n", b"\x0a")] and not any(s == b"n" for s, _ in tx.write_conflicts)
    inner = tx.nested()
    inner.put(b"q", b"x")
    assert b"q" not in tx.writes
    tx.merge(inner)
    assert tx.get(b"q") == b"x"
    empty = Transaction(base.limit(0))
    empty.put(b"k", b"v")
    assert empty.get_range(b"a").count() == 1


def test_transact_outcomes(spark):
    base = spark.createDataFrame([], "key binary, value binary")
    seen = []

    def commit(tx):
        seen.append(tx)
        if len(seen) < 3:
            raise Aborted
        return 7

    assert transact(lambda: (base, 1), commit, lambda tx: tx.put(b"k", b"v")) == ("ok", None, 7) and len(seen) == 3
    assert transact(lambda: (base, 1), commit, lambda tx: ("error", "no")) == ("error", "no")

    def stop(tx):
        raise Rollback("why")

    assert transact(lambda: (base, 1), commit, stop) == ("error", "why")
    seen.clear()
    assert transact(lambda: (base, 1), commit, lambda tx: tx.put(b"k", b"v"), retry_limit=1) == ("error", "aborted")
    assert coalesced([(b"a", b"b"), (b"b", b"c"), (b"x", b"y"), (b"y", b"y")]) == [(b"a", b"c"), (b"x", b"y")]


def test_logs_snapshots_objects(spark, tmp_path):
    rows = [(i % 3, i, i % 7, "set", str(i)) for i in range(60)]
    log = spark.createDataFrame(rows, "tag int, version long, k long, op string, operand string")
    logs.append(log, str(tmp_path / "log"))
    back = logs.read(spark, str(tmp_path / "log"))
    assert back.count() == 60 and [r["version"] for r in logs.pull(back.withColumn("txn", F.lit(0)).withColumn("seq", F.lit(0)), 10, 3).collect()] == [11, 12, 13]
    assert logs.durable(back).first()["version"] == 57 and logs.trimmed(back, 57).count() == 2
    many = log.withColumn("txn", F.lit(0)).withColumn("seq", F.col("tag")).withColumn("version", F.floor(F.col("version") / 3))
    assert logs.in_order(many.union(many)).count() == 60  # whole transactions of three mutations
    again = many.withColumn("push", F.lit(1)).union(many.limit(7).withColumn("k", F.lit(-1)).withColumn("push", F.lit(2)))
    assert logs.in_order(again, "push").where("k >= 0").count() == 60
    assert [r["version"] for r in logs.pull(many, 10, 2).collect()] == [11] * 3 + [12] * 3 and logs.pull(many, 5, 10**6).count() == 42
    for bad in ({"oldest": 11}, {"until": 9}):
        with pytest.raises(logs.LogError):
            logs.pull(many, 10, **bad)
    there = logs.shard_pull(many.where("version > 15"), many.where("version <= 15"), 1, 12, 2)
    assert {r["version"] for r in there.collect()} == {16, 17} and {r["version"] for r in logs.shard_pull(many.limit(0), many, 1, 12, 2).collect()} == {12, 13}
    pushes = spark.createDataFrame([(9, 10, 5, 1), (10, 14, 5, 2), (10, 11, 5, 3), (14, 15, 10_000_001, 4), (15, 16, 5, 5), (3, 4, 5, 6), (20, 20, 5, 7)], "expected long, version long, bytes long, arrival int")
    states = {(r["expected"], r["arrival"]): r["state"] for r in logs.decided(pushes, 9).collect()}
    assert states == {(9, 1): "accepted", (10, 2): "accepted", (10, 3): "tx_out_of_order", (14, 4): "tx_too_large", (15, 5): "waiting", (3, 6): "tx_out_of_order", (20, 7): "tx_out_of_order"}
    found = logs.push(spark.createDataFrame([(0, v, v, "set", "x") for v in (10, 11, 14, 16)], log.schema), pushes, str(tmp_path / "pushed"), 9)
    assert found.count() == 7 and sorted(r["version"] for r in logs.read(spark, str(tmp_path / "pushed")).collect()) == [10, 14]
    shots = Snapshots(spark, str(tmp_path / "shots"))
    assert shots.read_latest() is None
    s = spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string")
    for v in (5, 9, 7):
        shots.write(v, s)
    assert shots.versions() == [9, 7, 5] and shots.latest_version() == 9 and shots.delete_older_than(7) == 1 and not shots.exists(5)
    changes = spark.createDataFrame([(1, 3, None), (3, 4, "c")], "key long, version long, value string")
    assert sorted(map(tuple, compacted(s, changes).collect())) == [(2, "b"), (3, "c")]
    o = Objects(spark, str(tmp_path / "objects"))
    assert o.list() == [] and o.get("x") is None and o.put_if_not_exists("d/x", b"1") and not o.put_if_not_exists("d/x", b"2")
    data, version = o.get_with_version("d/x")
    assert data == b"1" and o.put_if_version("d/x", b"3", version) and not o.put_if_version("d/x", b"4", version) and o.get("d/x") == b"3"
    o.put("e", b"")
    assert o.list() == ["d/x", "e"] and o.list("d/") == ["d/x"] and o.delete("e") and o.list() == ["d/x"]
    tools.write_dump(tools.dump(kv(spark, LOG).select("key", "value")), str(tmp_path / "dump"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "dump")).count() == 5
    with pytest.raises(ValueError):
        tools.write_dump(log, "x", "xml")


def test_allocator(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 63, 64, 255, 256, 1280, 65791, 65792, 80000)], "id long")
    assert sorted((r["start"], r["size"]) for r in allocator.windows(ids, "id").collect()) == [(0, 64), (64, 64), (192, 64), (256, 1024), (1280, 1024), (64768, 1024), (65792, 8192), (73984, 8192)]
    got = allocator.allocate_many(ids, "id", 5000).collect()  # the open window is left alone, the next ones are half filled
    assert len({r["id"] for r in got}) == 5000 and min(r["id"] for r in got) >= 82_176
    none = [r["id"] for r in allocator.allocate_many(ids.limit(0), "id", 3000).collect()]
    assert len(set(none)) == 3000
    by = [sum(s <= i < s + n for i in none) for s, n in ((0, 64), (64, 64), (128, 64), (192, 64), (256, 1024), (1280, 1024))]
    assert by == [31, 31, 31, 31, 511, 511]
    open_ = [r["window"] for r in allocator.allocated(spark.range(40), "id", start=64, used=30).orderBy("id").collect()]
    assert open_[0] == 64 and open_[1:32] == [128] * 31 and open_[32] == 192


def test_persistence_queue():
    from tidepool.plans.batching import PersistenceQueue

    q = PersistenceQueue(capacity=2, retries=1)
    assert q.enqueue("a") and q.enqueue("b") and not q.enqueue("c") and q.dequeue() == (1, "a")
    assert q.nack(1, now=100) == "rescheduled" and q.next_retry_due() == 125 and q.counts() == {"pending": 1, "scheduled": 1, "in_flight": 0, "lag": 2}
    assert q.dequeue(now=110) == (2, "b") and q.ack(2) and not q.ack(2) and q.dequeue(now=110) is None
    assert q.dequeue(now=125) == (3, "a") and q.nack(3) == "dropped" and q.nack(9) == "unknown_token" and q.dequeue() is None
    with pytest.raises(ValueError):
        PersistenceQueue(capacity=0)


def test_names_of_selectors_and_keyspaces():
    from tidepool.plans.keyspace import Keyspace, to_keyspace, to_range

    s = selectors
    assert str(s.first_greater_or_equal(b"u")) == "first_greater_or_equal(b'u')" and str(s.last_less_than(b"u")) == "last_less_than(b'u')"
    assert str(s.first_greater_than(b"u").add(3)) == "first_greater_or_equal(b'u') + 4" and str(s.last_less_or_equal(b"u").subtract(2)) == "first_greater_or_equal(b'u') - 3"
    assert [x.sign() for x in (s.first_greater_than(b"u"), s.last_less_than(b"u"), s.last_less_or_equal(b"u"))] == [1, 0, -1]
    space = Keyspace.all().partition(b"app").add("users")
    assert space.unpack(space.key(7, "x"))[0] == 7 and str(Keyspace(b"a")) == "Keyspace<b'a'>" and to_range(Keyspace.all()) == (b"", b"\xff")
    with pytest.raises(ValueError):
        space.unpack(b"zzz")
    with pytest.raises(ValueError):
        space.partition("text")
    from pyspark.sql import Row

    row = Row(path=["a"], prefix=bytearray(b"\x15"), layer=None)
    assert to_keyspace(row).prefix == b"\x15" and to_range(row) == (b"\x15", b"\x16")


def test_directory_root_and_partitions(spark):
    t = directory.create(directory.create(directory.root(spark), ["a"], b"\x01", "partition"), ["b"], b"\x02", "text")
    assert directory.layout_version(t) == (1, 0, 0) and directory.layer_of(directory.open_(t, ["b"]).first()) == "text" and directory.path_of(directory.open_(t, ["b"]).first()) == ["b"]
    for call, error in (
        (lambda: directory.moved(t, ["a"], ["c"]), "partition"), (lambda: directory.moved(t, ["b"], ["a"]), "already_exists"), (lambda: directory.moved(t, ["b"], ["x", "y"]), "parent"),
        (lambda: directory.moved(t, ["z"], ["c"]), "does_not_exist"), (lambda: directory.removed(t, ["z"]), "does_not_exist"),
        (lambda: directory.create(directory.root(spark, (1, 2, 0)), ["n"], b"\x05"), "restricted"), (lambda: directory.open_(directory.root(spark, (2, 0, 0)), ["n"]), "incompatible"),
    ):
        with pytest.raises(directory.DirectoryError, match=error):
            call()
    assert directory.removed_if_exists(t, ["z"]).count() == 3 and directory.removed(t, ["a"]).count() == 2
    assert sorted(tuple(r["path"]) for r in directory.moved(t, ["b"], ["c"]).collect()) == [(), ("a",), ("c",)]


def test_appends_and_clears_against_model(spark):
    rng = random.Random(21)
    rows = [(f"k{rng.randrange(6)}", v, 0, 0, rng.choice(["set", "compare_and_clear"]), bytearray(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))))) for v in range(200)]
    df = spark.createDataFrame(rows, "key string, version long, txn int, seq int, op string, operand binary").repartition(3)
    appended, cleared = {}, {}
    for k, _, _, _, op, x in rows:
        old = appended.setdefault(k, b"")
        appended[k] = old + bytes(x) if len(old) + len(x) <= 30 else old
        cleared[k] = bytes(x) if op == "set" else None if cleared.get(k) == bytes(x) else cleared.get(k)
    assert {r["key"]: bytes(r["value"]) for r in folds.append_if_fits(df, 30).collect()} == appended
    assert {r["key"]: None if r["value"] is None else bytes(r["value"]) for r in folds.compare_and_clear(df).collect()} == cleared


def test_state_is_written_by_changes(spark, tmp_path):
    from tidepool.streaming.materialise import State

    schema, model = "k long, version long, value string", {}
    state = State(spark, str(tmp_path / "state"), compact=3)
    assert state.read(schema).count() == 0
    for epoch in range(8):
        rows = [((epoch * 7 + i) % 10, epoch * 10 + i, None if i == 2 else f"{epoch}.{i}") for i in range(4)]
        model |= {k: (v, x) for k, v, x in rows}
        for _ in range(2 if epoch in (2, 4) else 1):  # a batch that is tried again
            state.sink(spark.createDataFrame(rows, schema), epoch)
        assert {r["k"]: (r["version"], r["value"]) for r in state.read(schema).collect()} == model
    assert state._epochs("base") == [5] and state._epochs("changes") == [6, 7]


def test_commits_wait_longer_each_time(spark):
    asked, waits = [], []

    def state():
        asked.append(1)
        return spark.createDataFrame([], "key binary, value binary"), 5

    def refuse(tx):
        raise Aborted

    assert transact(state, refuse, lambda tx: tx.put(b"k", b"v"), retry_limit=3, wait=waits.append) == ("error", "aborted")
    assert len(waits) == 3 and waits == sorted(waits) and not asked  # a blind write asks for no read version
    assert transact(state, lambda tx: 9, lambda tx: tx.get(b"k")) == ("ok", None, 5) and len(asked) == 1
