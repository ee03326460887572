import random
import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidepool.functions import atomics, keys, tuples
from tidepool.operators import routing
from tidepool.plans.keyspace import Keyspace, to_keyspace, to_range
from tidepool.sources.snapshots import name_of, version_of


def test_strinc_and_ranges():
    assert keys.strinc(b"a\xff\xff") == b"b"
    with pytest.raises(ValueError):
        keys.strinc(b"\xff")
    assert keys.from_prefix(b"ab") == (b"ab", b"ac")
    assert keys.to_range(b"k") == (b"k", b"k\x00")
    with pytest.raises(ValueError):
        keys.key_range(b"b", b"a")
    assert keys.key_range(b"a")[1] == keys.END


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_prefix_range_holds_exactly_the_prefixed(prefix, key):
    if prefix.rstrip(b"\xff"):
        s, e = keys.from_prefix(prefix)
        assert (s <= key < e) == key.startswith(prefix)


nested = st.recursive(st.none() | st.integers(-(2**64) + 1, 2**64 - 1) | st.binary(max_size=5) | st.floats(allow_nan=False), lambda x: st.lists(x, max_size=3) | st.lists(x, max_size=3).map(tuple), max_leaves=6)


@given(st.lists(nested, max_size=4))
@settings(max_examples=300)
def test_tuples_round_trip(items):
    assert tuples.unpack(tuples.pack(*items)) == items


@given(st.integers(-(2**64) + 1, 2**64 - 1), st.integers(-(2**64) + 1, 2**64 - 1))
def test_integers_keep_their_order(a, b):
    assert (tuples.pack(a) < tuples.pack(b)) == (a < b)


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_binaries_keep_their_order(a, b):
    assert (tuples.pack(a, 1) < tuples.pack(b, 1)) == ((a, 1) < (b, 1))


def test_tuple_bytes_and_errors():
    assert tuples.pack(5) == b"\x15\x05" and tuples.pack((1,)) == b"\x05\x15\x01\x00" and tuples.pack(None) == b"\x00\xff"
    assert tuples.pack(1.5) == b"\x21" + struct.pack(">d", 1.5) and tuples.pack(-1) == b"\x13\xfe"
    for bad in (True, object()):
        with pytest.raises(TypeError):
            tuples.pack(bad)
    with pytest.raises(OverflowError):
        tuples.pack(2**64)
    for cut in (b"\x15", b"\x21\x00", b"\x05\x15\x01", b"\x77"):
        with pytest.raises(ValueError):
            tuples.unpack(cut)


def test_packed_columns_agree_with_python(spark):
    ints = [0, 1, 255, 256, -1, -255, -256, 2**40, -(2**40), 2**63 - 1]
    rows = spark.createDataFrame([(i,) for i in ints], "i long").select("i", tuples.pack_int(F.col("i")).alias("k"), tuples.unpack_int(tuples.pack_int(F.col("i")), F.lit(1)).alias("back")).collect()
    assert all(bytes(r["k"]) == tuples.pack(r["i"]) and r["back"] == r["i"] for r in rows)
    data = [b"", b"a", b"\x00", b"a\x00b\x00", b"\xff\x00\xff", b"\x10\x00\x01"]
    rows = spark.createDataFrame([(bytearray(x),) for x in data], "b binary").select("b", tuples.pack_bytes(F.col("b")).alias("k")).collect()
    assert all(bytes(r["k"]) == tuples.pack(bytes(r["b"])) for r in rows)


def test_key_columns_agree_with_python(spark):
    data = [b"a", b"a\xff", b"\xff", b"\x00", b"\x0f\xff", b"\xff\x01", b"\x1f"]
    rows = spark.createDataFrame([(bytearray(x),) for x in data], "k binary").select("k", keys.key_after_col(F.col("k")).alias("after"), keys.strinc_col(F.col("k")).alias("next")).collect()
    for r in rows:
        k = bytes(r["k"])
        assert bytes(r["after"]) == keys.key_after(k)
        assert (r["next"] is None) if not k.rstrip(b"\xff") else bytes(r["next"]) == keys.strinc(k)


def test_little_endian_columns(spark):
    vals = [0, 1, 255, 256, 65535, 2**40 + 3]
    rows = spark.createDataFrame([(v,) for v in vals], "v long").select("v", keys.le_encode(F.col("v"), 6).alias("b"), keys.le_decode(keys.le_encode(F.col("v"), 6)).alias("back")).collect()
    assert all(bytes(r["b"]) == r["v"].to_bytes(6, "little") and r["back"] == r["v"] for r in rows)
    assert spark.range(1).select(keys.le_decode(F.unhex(F.lit(""))).alias("x")).first()["x"] == 0


def test_inverted_keys(spark):
    vals = [0, 1, 1000, 2**62]
    rows = spark.createDataFrame([(v,) for v in vals], "v long").select("v", keys.inverted_key(F.col("v")).alias("k"), keys.version_of_inverted(keys.inverted_key(F.col("v"))).alias("back"), keys.chunk_path(F.lit(10), F.col("v")).alias("p")).collect()
    for r in rows:
        assert r["k"] == name_of(r["v"]) and version_of(r["k"]) == r["v"] == r["back"]
    assert rows[0]["k"] == "3w5e11264sgsf" and rows[2]["p"] == "c/a/3w5e11264sg0n"
    assert [r["k"] for r in rows] == sorted((r["k"] for r in rows), reverse=True)


def test_versions_refuse_to_leave_their_range(spark):
    df = spark.range(1).select(keys.version_add(F.lit(3), F.lit(-5)).alias("v"))
    with pytest.raises(Exception, match="out of range"):
        df.collect()


@pytest.mark.parametrize(
    ("op", "old", "new", "want"),
    [
        ("add", b"\x01", b"\x02", b"\x03"), ("add", b"\xff", b"\x01", b"\x00\x01"), ("add", b"", b"\x05", b"\x05"), ("add", b"\x05", b"", b""), ("add", b"\x01\x02", b"\x01", b"\x02"),
        ("add", b"\x01", b"\x01\x00", b"\x02\x00"), ("min", b"\x05", b"\x03", b"\x03"), ("min", b"\x03", b"\x05\x00", b"\x03\x00"), ("max", b"\x05", b"\x03", b"\x05"), ("max", b"", b"\x01", b"\x01"),
        ("bit_and", b"\x0f", b"\x05\xff", b"\x05\x00"), ("bit_or", b"\x0f", b"\xf0", b"\xff"), ("bit_xor", b"\xff", b"\x0f", b"\xf0"), ("byte_max", b"b", b"a", b"b"), ("byte_max", b"b", b"", b""),
        ("byte_min", b"a", b"bb", b"a\x00"), ("byte_min", b"", b"z", b"z"), ("append_if_fits", b"a", b"b", b"ab"), ("append_if_fits", b"a" * 131072, b"b", b"a" * 131072), ("append_if_fits", b"a", b"", b"a"),
        ("compare_and_clear", b"a", b"a", None), ("compare_and_clear", b"a", b"b", b"a"), ("compare_and_clear", b"", b"b", None),
    ],
)
def test_atomics(op, old, new, want):
    assert atomics.apply(op, old, new) == want


def test_log_choice():
    assert routing.log_indices(0, 5, 2) == [1, 0] and routing.log_indices(7, 5, 1) == [2]
    assert routing.log_indices(3, 5, 0) == []
    assert all(len(set(routing.log_indices(t, 5, 5))) == 5 for t in range(20))


def test_keyspaces():
    k = Keyspace().add("a", 1)
    assert k.prefix == tuples.pack("a", 1) and k.contains(k.key(2)) and to_range(k) == keys.from_prefix(k.prefix)
    assert to_range(b"") == (b"", b"\xff") and to_keyspace(b"p").prefix == b"p"
    with pytest.raises(TypeError):
        to_range(3)


def test_random_atomics_match_integers():
    rng = random.Random(1)
    for _ in range(500):
        a, b = rng.randrange(2**16), rng.randrange(2**16)
        x, y = a.to_bytes(2, "little"), b.to_bytes(2, "little")
        assert int.from_bytes(atomics.apply("add", x, y), "little") == a + b
        assert int.from_bytes(atomics.apply("bit_xor", x, y), "little") == a ^ b
        assert int.from_bytes(atomics.apply("max", x, y), "little") == max(a, b)
