"""The ten atomic operations: folds of operands into a value, little-endian where they count.

apply() is one step in Python; the ordered fold over a mutation log builds on it (operators/folds.py).
None is a cleared value; an empty value counts as missing.
"""
from __future__ import annotations

from .keys import MAX_VALUE


def _fit(value: bytes, n: int) -> bytes:
    return value[:n].ljust(n, b"\x00")


def _number(b: bytes) -> int:
    return int.from_bytes(b, "little")


def _add(old: bytes, new: bytes) -> bytes:
    n = len(new)
    total = _number(_fit(old, n)) + _number(new)
    return total.to_bytes(n + (total >> (8 * n) > 0), "little")


def _bits(f):
    return lambda old, new: bytes(f(a, b) for a, b in zip(_fit(old, len(new)), new, strict=True))


def _pick(better):
    return lambda old, new: _fit(old, len(new)) if better(_number(_fit(old, len(new))), _number(new)) else new


_OPS = {
    "add": _add,
    "min": _pick(lambda a, b: a < b),
    "max": _pick(lambda a, b: a > b),
    "bit_and": _bits(lambda a, b: a & b),
    "bit_or": _bits(lambda a, b: a | b),
    "bit_xor": _bits(lambda a, b: a ^ b),
}
NAMES = (*_OPS, "byte_min", "byte_max", "append_if_fits", "compare_and_clear")


def apply(op: str, old: bytes | None, new: bytes) -> bytes | None:
    """The value after one operation on old (None: missing)."""
    old = old or b""
    if op == "compare_and_clear":
        return None if old == new else old or None
    if op not in NAMES:
        raise ValueError(f"unknown atomic operation {op!r}")
    if not old:
        return new
    if op == "append_if_fits":
        return old + new if len(old) + len(new) <= MAX_VALUE else old
    if op in ("byte_min", "byte_max"):
        wins = old < new if op == "byte_min" else old > new
        return _fit(old, len(new)) if wins else new
    return _OPS[op](old, new) if new else b""
