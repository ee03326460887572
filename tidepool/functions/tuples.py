"""Order-preserving tuple encoding: nil, byte strings, integers, floats, tuples and lists.

Columns pack flat integers and strings in SQL expressions; pack() and unpack() handle any nesting in Python.
"""
from __future__ import annotations

import struct

from pyspark.sql import Column, functions as F

#: The tag bytes of the format.
NIL, BINARY, TUPLE, LIST, ZERO, FLOAT = 0x00, 0x01, 0x05, 0x06, 0x14, 0x21
#: Integers lie strictly between -(2^64) and 2^64.
INT_LIMIT = 2**64 - 1


def _pack_one(x) -> bytes:
    if x is None:
        return b"\x00\xff"
    if isinstance(x, bool):
        raise TypeError("booleans have no tuple encoding")
    if isinstance(x, str):
        x = x.encode()
    if isinstance(x, (bytes, bytearray)):
        return bytes([BINARY]) + bytes(x).replace(b"\x00", b"\x00\xff") + b"\x00"
    if isinstance(x, int):
        if abs(x) > INT_LIMIT:
            raise OverflowError("integer beyond 64 bits")
        n = (abs(x).bit_length() + 7) // 8
        body = abs(x).to_bytes(n, "big")
        return bytes([ZERO + n]) + body if x >= 0 else bytes([ZERO - n]) + bytes(255 - b for b in body)
    if isinstance(x, float):
        return bytes([FLOAT]) + struct.pack(">d", x)
    if isinstance(x, tuple):
        return bytes([TUPLE]) + b"".join(map(_pack_one, x)) + b"\x00"
    if isinstance(x, list):
        return bytes([LIST]) + b"".join(map(_pack_one, x)) + b"\x00"
    raise TypeError(f"no tuple encoding for {type(x).__name__}")


def pack(*items) -> bytes:
    """The items one after the other, without a tag around them."""
    return b"".join(map(_pack_one, items))


def _unpack_one(b: bytes, at: int):
    tag = b[at]
    if b[at : at + 2] == b"\x00\xff":
        return None, at + 2
    if tag == BINARY:
        out, at = bytearray(), at + 1
        while True:
            stop = b.index(0, at)
            out += b[at:stop]
            if b[stop + 1 : stop + 2] != b"\xff":
                return bytes(out), stop + 1
            out.append(0)
            at = stop + 2
    if tag in (TUPLE, LIST):
        items, at = [], at + 1
        while b[at] != 0 or b[at : at + 2] == b"\x00\xff":
            x, at = _unpack_one(b, at)
            items.append(x)
        return (tuple(items) if tag == TUPLE else items), at + 1
    if ZERO - 8 <= tag <= ZERO + 8:
        n = abs(tag - ZERO)
        body = b[at + 1 : at + 1 + n]
        if len(body) != n:
            raise ValueError("integer cut short")
        v = int.from_bytes(body if tag >= ZERO else bytes(255 - x for x in body), "big")
        return (v if tag >= ZERO else -v), at + 1 + n
    if tag == FLOAT:
        return struct.unpack(">d", b[at + 1 : at + 9])[0], at + 9
    raise ValueError(f"unknown tag {tag:#04x}")


def unpack(b: bytes) -> list:
    """The items of a packed key; an error if bytes are left over or missing."""
    out, at = [], 0
    try:
        while at < len(b):
            x, at = _unpack_one(b, at)
            out.append(x)
    except (IndexError, struct.error) as e:
        raise ValueError("packed key cut short") from e
    return out


def pack_int(value: Column) -> Column:
    """Packed form of a long above the smallest one; null where the value is null."""
    v = value.cast("long")
    mag = F.abs(v)
    h = F.hex(mag)
    h = F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h)
    n = (F.length(h) / 2).cast("int")
    positive = F.concat(F.hex(F.lit(ZERO) + n), h)
    negative = F.concat(F.lpad(F.hex(F.lit(ZERO) - n), 2, "0"), F.translate(h, "0123456789ABCDEF", "FEDCBA9876543210"))
    return F.unhex(F.when(v == 0, F.lit("14")).when(v > 0, positive).otherwise(negative))


def pack_bytes(value: Column) -> Column:
    """Packed form of a string or binary column; null where the value is null."""
    body = F.regexp_replace(F.hex(value.cast("binary")), "(..)", "$1 ")
    body = F.replace(F.replace(body, F.lit("00 "), F.lit("00FF ")), F.lit(" "), F.lit(""))
    return F.unhex(F.concat(F.lit("01"), body, F.lit("00")))


def pack_columns(*cols: Column) -> Column:
    """Packed columns one after the other; each is the result of pack_int or pack_bytes."""
    return F.concat(*cols)


def unpack_int(packed: Column, at: Column) -> Column:
    """The integer whose tag byte stands at position `at` (from 1)."""
    tag = F.conv(F.hex(F.substr(packed, at, F.lit(1))), 16, 10).cast("int")
    n = F.abs(tag - ZERO)
    h = F.hex(F.substr(packed, at + 1, n))
    h = F.when(tag < ZERO, F.translate(h, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(h)
    v = F.coalesce(F.conv(h, 16, 10).cast("long"), F.lit(0).cast("long"))
    return F.when(tag < ZERO, -v).otherwise(v)


def int_length(packed: Column, at: Column) -> Column:
    """Bytes that the packed integer at position `at` (from 1) takes, its tag included."""
    return F.abs(F.conv(F.hex(F.substr(packed, at, F.lit(1))), 16, 10).cast("int") - ZERO) + 1
