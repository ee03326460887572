"""Keys, ranges and versions: byte strings in unsigned lexicographic order, and 64-bit versions.

Helpers come in two forms: plain Python for literals, and Column expressions for data.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The end of the keyspace, above every user key.
END = b"\xff\xff"
#: How long keys and appended values may be.
MAX_KEY, MAX_VALUE = 16_384, 131_072
#: Versions are unsigned 64-bit at the edge; inverted ones sort newest first.
MAX_VERSION = 2**64 - 1


def key_after(key: bytes) -> bytes:
    """The smallest key above key."""
    return key + b"\x00"


def strinc(prefix: bytes) -> bytes:
    """The smallest key above every key that starts with prefix."""
    trimmed = prefix.rstrip(b"\xff")
    if not trimmed:
        raise ValueError("a key of only FF bytes has no successor prefix")
    return trimmed[:-1] + bytes([trimmed[-1] + 1])


def key_range(start: bytes, end: bytes | None = None) -> tuple[bytes, bytes]:
    """A half-open range; end None is the end of the keyspace."""
    stop = END if end is None else end
    if start >= stop:
        raise ValueError("a range must start before its end")
    return start, stop


def from_prefix(prefix: bytes) -> tuple[bytes, bytes]:
    return prefix, strinc(prefix)


def to_range(key: bytes) -> tuple[bytes, bytes]:
    return key, key_after(key)


def contains(key: Column, start, end) -> Column:
    """start <= key < end. Bounds that are bytes become literals, which parquet scans can use."""
    s, e = (F.lit(bytearray(x)) if isinstance(x, (bytes, bytearray)) else x for x in (start, end))
    return (key >= s) & (key < e)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def key_after_col(key: Column) -> Column:
    return F.concat(key, F.unhex(F.lit("00")))


def strinc_col(key: Column) -> Column:
    """strinc of each key; null where every byte is FF."""
    digits = F.regexp_replace(F.hex(key), "^((?:..)*?)(?:FF)*$", "$1")
    n = F.length(digits)
    tail = F.conv(F.substr(digits, n - 1, F.lit(2)), 16, 10).cast("int") + 1
    return F.when(n >= 2, F.unhex(F.concat(F.substr(digits, F.lit(1), n - 2), F.lpad(F.hex(tail), 2, "0"))))


def le_decode(value: Column) -> Column:
    """A little-endian unsigned integer of at most 7 bytes as a long; empty is 0."""
    n = F.octet_length(value)
    digit = lambda i: F.conv(F.hex(F.substr(value, i, F.lit(1))), 16, 10).cast("long")
    walk = F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), F.lit(0).cast("long"), lambda a, i: a * 256 + digit(i))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(walk)


def le_encode(value: Column, width: int) -> Column:
    """A non-negative long as width little-endian bytes, higher ones cut off."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substr(digits, F.lit(15 - 2 * i), F.lit(2)) for i in range(min(width, 8))], *[F.lit("00")] * max(0, width - 8)))


def version_bytes(version: Column) -> Column:
    """The eight big-endian bytes of a version."""
    return F.unhex(F.lpad(F.hex(version), 16, "0"))


def inverted_key(version: Column) -> Column:
    """(2^64 - 1) - version as 13 base-36 digits in lower case, so that the newest sorts first."""
    rest = F.lit(str(MAX_VERSION)).cast("decimal(20,0)") - version.cast("decimal(20,0)")
    return F.lpad(F.lower(F.conv(rest.cast("decimal(20,0)").cast("string"), 10, 36)), 13, "0")


def version_of_inverted(key: Column) -> Column:
    number = F.conv(F.upper(key), 36, 10).cast("decimal(20,0)")
    return (F.lit(str(MAX_VERSION)).cast("decimal(20,0)") - number).cast("long")


def shard_tag(shard: Column) -> Column:
    return F.lower(F.conv(shard.cast("string"), 10, 36))


def chunk_path(shard: Column, version: Column) -> Column:
    return F.concat_ws("/", F.lit("c"), shard_tag(shard), inverted_key(version))


def snapshot_path(shard: Column, version: Column) -> Column:
    return F.concat_ws("/", F.lit("s"), shard_tag(shard), inverted_key(version))


def version_add(version: Column, by: Column) -> Column:
    """version + by, an error where it leaves the range of versions kept as longs."""
    total = version.cast("decimal(20,0)") + by.cast("decimal(20,0)")
    return F.when(total.between(0, 2**63 - 1), total.cast("long")).otherwise(F.raise_error(F.lit("version out of range")).cast("long"))


def version_distance(a: Column, b: Column) -> Column:
    """a - b, exact where it leaves the longs."""
    return a.cast("decimal(20,0)") - b.cast("decimal(20,0)")


def version_sequence(base: Column, count: Column) -> Column:
    """The `count` (1 or more) versions after base, as an array."""
    return F.sequence(version_add(base, F.lit(1)), version_add(base, count))


def version_valid(value: Column) -> Column:
    """Whether a binary value is a version: eight bytes."""
    return F.coalesce(F.octet_length(value) == 8, F.lit(False))


def version_string(version: Column) -> Column:
    """A version's bytes in decimal, as <0,0,0,0,0,0,1,2>; null as nil."""
    digits = F.lpad(F.hex(version), 16, "0")
    byte = lambda i: F.conv(F.substr(digits, F.lit(2 * i + 1), F.lit(2)), 16, 10)
    return F.coalesce(F.concat(F.lit("<"), F.concat_ws(",", *[F.when(version.isNotNull(), byte(i)) for i in range(8)]), F.when(version.isNotNull(), F.lit(">"))), F.lit("nil"))


#: Where system keys begin, and the kinds of them, more specific starts first.
SYSTEM = b"\xff/system"
SYSTEM_KINDS = {"layout_log": "/layout/logs/", "shard_key": "/shard_keys/", "shard": "/shards/", "materializer_key": "/materializer_keys/"}


def is_system_key(key: Column) -> Column:
    """As a range, which parquet scans can use."""
    return contains(key, SYSTEM, strinc(SYSTEM))


def is_metadata_key(key: Column) -> Column:
    return key >= F.lit(bytearray(b"\xff"))


def system_kind(key: Column) -> tuple[Column, Column]:
    """What kind of system key it is and its parameter's bytes: unknown for others of the system's, error for other keys."""
    kind, rest = F.when(is_system_key(key), "unknown").otherwise("error"), F.lit(None).cast("binary")
    for name, start in reversed(SYSTEM_KINDS.items()):
        p = SYSTEM + start.encode()
        inside = contains(key, p, strinc(p))
        kind, rest = F.when(inside, name).otherwise(kind), F.when(inside, F.substr(key, F.lit(len(p) + 1))).otherwise(rest)
    return kind, rest


def random_id(bytes_: int = 5) -> Column:
    """A random id of so many bytes (16 at most), in hex."""
    return F.substr(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), F.lit(1), F.lit(2 * bytes_))


def compare_versions(a: Column, b: Column) -> Column:
    return F.signum((a - b).cast("double")).cast("int")


def window_size(start: Column) -> Column:
    """How many ids the allocator's window at start spans."""
    return F.when(start < 255, 64).when(start < 65_535, 1024).otherwise(8192)


def candidate_bytes(candidate: Column) -> Column:
    """An id as its length in one byte, then its big-endian bytes."""
    h = F.hex(candidate)
    h = F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h)
    return F.unhex(F.concat(F.lpad(F.hex(F.length(h) / 2), 2, "0"), h))


def retry_backoff_ms(attempt: Column) -> Column:
    """Milliseconds before a persistence retry."""
    return (F.lit(25) * F.pow(F.lit(2), attempt - 1)).cast("long")
