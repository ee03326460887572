import pytest
from hypothesis import given, strategies as st

from tidepool.sources import files

records = st.lists(st.tuples(st.integers(0, 2**63 - 1), st.binary(max_size=20)), min_size=1, max_size=8, unique_by=lambda r: r[0]).map(sorted)


@given(records, st.integers(0, 2**63 - 1))
def test_round_trips(rs, low):
    assert list(files.read_segment(files.write_segment(rs))) == rs
    data = files.write_chunk(rs)
    assert list(files.read_chunk(data)) == rs and list(files.read_chunk(data, low)) == [r for r in rs if r[0] >= low]
    assert files.chunk_header(data) == {"min_version": rs[0][0], "max_version": rs[-1][0], "n": len(rs)}


@given(st.dictionaries(st.sampled_from(sorted(files.SECTIONS)), st.binary(max_size=30)))
def test_payloads(sections):
    data = files.write_payload(sections)
    assert files.read_payload(data) == sections
    assert files.read_payload(data, {4}) == {k: v for k, v in sections.items() if k == 4}


@given(records, st.data())
def test_damage_is_found(rs, draw):
    data = bytearray(files.write_segment(rs))
    at = draw.draw(st.integers(0, len(data) - 1))
    data[at] ^= 1 << draw.draw(st.integers(0, 7))
    try:
        got = list(files.read_segment(bytes(data)))
    except files.Corrupted:
        return
    assert [p for _, p in got] == [p for _, p in rs] or len(got) < len(rs) or at >= len(data) - 16  # only versions and the end are unchecked
    with pytest.raises(files.Corrupted):
        list(files.read_segment(b"nope"))


def test_load(spark, tmp_path):
    (tmp_path / "a.seg").write_bytes(files.write_segment([(i, bytes([i])) for i in range(10)]))
    (tmp_path / "b.seg").write_bytes(files.write_segment([(i, b"x") for i in range(20, 25)])[:-30])
    rows = files.load(spark, str(tmp_path), at_least=5).collect()
    assert sorted(r["version"] for r in rows if r["error"] is None) == [5, 6, 7, 8, 9, 20, 21, 22, 23]
    assert [r["path"].endswith("b.seg") for r in rows if r["error"]] == [True]
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "c").write_bytes(files.write_chunk([(i, b"p") for i in range(8)]))
    assert files.load(spark, str(tmp_path / "chunks"), "chunk", 6).count() == 2


def test_chunks_of_a_store(spark, tmp_path):
    from tidepool.sources.chunks import Chunks, shard_name

    rows = [(t, v, bytearray(bytes([v % 256]) * (10 + v % 7))) for t in (1, 40) for v in range(100, 200, 1 if t == 1 else 3)]
    rows += [(1, 5000, bytearray(b"late"))]
    log = spark.createDataFrame(rows, "tag int, version long, payload binary").repartition(5)
    store = Chunks(spark, str(tmp_path / "chunks"))
    assert store.latest_version(1) is None and store.read_from(1).count() == 0 and shard_name(40) == "14"
    n = store.write(log, 200, 1000)
    assert n > 8 and store.write(log, 200, 1000) == 0  # written once
    found = store.metadata(1).orderBy("min_version").collect()
    assert sum(r["n"] for r in found) == 101 and all(a["max_version"] < b["min_version"] for a, b in zip(found, found[1:]))
    assert found[-1]["min_version"] == 5000  # a gap flushes
    assert (store.oldest_version(1), store.latest_version(1), store.latest_version(40)) == (100, 5000, 199)
    assert store.find(1, 150) in store.paths(1) and store.find(1, 300) is None and store.find(1, 6000) is None
    got = {r["version"]: bytes(r["payload"]) for r in store.read_from(1, 150).collect()}
    assert got == {v: bytes(x) for t, v, x in rows if t == 1 and v >= 150}


def test_versions_beyond_the_longs_are_errors(spark, tmp_path):
    from tidepool.sources import files

    (tmp_path / "s").write_bytes(files.write_segment([(5, b"a"), (2**63, b"b")]))
    rows = files.load(spark, str(tmp_path / "s")).collect()
    assert [(r["version"], r["error"] is None) for r in rows] == [(5, True), (None, False)]
