"""Keyspaces: a prefix with encodings, and what can be turned into a range."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import singledispatch

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.keys import contains, strinc
from ..functions.tuples import pack, unpack


@dataclass(frozen=True)
class Keyspace:
    """A named part of the keys; decoders turn binary columns into typed ones."""

    prefix: bytes = b""
    decode_key: Callable[[Column], Column] | None = None
    decode_value: Callable[[Column], Column] | None = None

    @staticmethod
    def all() -> Keyspace:
        """The keyspace of all keys."""
        return Keyspace()

    def add(self, *names) -> Keyspace:
        """The keyspace below this one for packed names."""
        return replace(self, prefix=self.prefix + pack(*names))

    def partition(self, name, encode: Callable | None = None, decode_key=None, decode_value=None) -> Keyspace:
        """The keyspace below this one for raw bytes, or for what `encode` makes of a name."""
        if encode is None and not isinstance(name, (bytes, bytearray)):
            raise ValueError("a keyspace without a key encoding is divided by bytes")
        prefix = self.prefix + (bytes(name) if encode is None else encode(name))
        return Keyspace(prefix, decode_key or self.decode_key, decode_value or self.decode_value)

    def key(self, *items) -> bytes:
        return self.prefix + pack(*items)

    def unpack(self, key: bytes) -> tuple:
        """The items of a key of this keyspace."""
        if not self.contains(key):
            raise ValueError("the key does not belong to this keyspace")
        return unpack(key[len(self.prefix) :])

    def __str__(self) -> str:
        return f"Keyspace<{self.prefix!r}>"

    def contains(self, key: bytes) -> bool:
        return key.startswith(self.prefix)

    def within(self, key: Column) -> Column:
        """As a range, which parquet scans can use; a prefix test they could not."""
        s, e = to_range(self)
        return contains(key, s, e)

    def scan(self, rows: DataFrame) -> DataFrame:
        """key, value of the rows inside, without the prefix and decoded."""
        key, value = F.substr(F.col("key"), F.lit(len(self.prefix) + 1)), F.col("value")
        key = self.decode_key(key) if self.decode_key else key
        value = self.decode_value(value) if self.decode_value else value
        return rows.where(self.within(F.col("key"))).select(key.alias("key"), value.alias("value"))


@singledispatch
def to_range(x) -> tuple[bytes, bytes]:
    """The half-open range of a prefix, a (start, end) pair or a keyspace."""
    raise TypeError(f"no range for {type(x).__name__}")


@to_range.register
def _(x: bytes) -> tuple[bytes, bytes]:
    return (x, strinc(x)) if x else (b"", b"\xff")


@to_range.register
def _(x: tuple) -> tuple[bytes, bytes]:
    return x


@to_range.register
def _(x: Keyspace) -> tuple[bytes, bytes]:
    return to_range(x.prefix)


@to_range.register
def _(x: Row) -> tuple[bytes, bytes]:
    return to_range(to_keyspace(x))


def to_keyspace(x) -> Keyspace:
    """A keyspace as it is, the one of a prefix, or that of a directory's row."""
    if isinstance(x, Keyspace):
        return x
    return Keyspace(bytes(x["prefix"] if isinstance(x, Row) else x))
