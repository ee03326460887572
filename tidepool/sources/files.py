"""Binary log segments and chunks as tables: framed records with checksums, read through Spark's binaryFile.

A segment is a magic, then records (version 8 bytes, size 4, payload, CRC-32 of the payload), then an
end marker. A chunk is a 32-byte header, a directory of (version, offset, length), then the payloads.
A payload's sections are tag, 24-bit size, CRC-32 over tag, size and body, body. Integers are big-endian.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the formats.
SEGMENT_MAGIC, CHUNK_MAGIC, PAYLOAD_MAGIC, FORMAT_VERSION = b"BED0", 0x42444348, 0x42524454, 1
END_VERSION = 2**64 - 1
SECTIONS = {1: "mutations", 2: "read_conflicts", 3: "write_conflicts", 4: "commit_version", 5: "shard_index"}
_HEADER = struct.Struct(">IBBHQQII")


class Corrupted(ValueError):
    pass


def write_segment(records: Iterable[tuple[int, bytes]]) -> bytes:
    out = [SEGMENT_MAGIC]
    for version, payload in records:
        out += [struct.pack(">QI", version, len(payload)), payload, struct.pack(">I", zlib.crc32(payload))]
    return b"".join([*out, struct.pack(">QII", END_VERSION, 0, 0)])


def read_segment(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Records up to the end marker; an error for a wrong magic, checksum or length."""
    if data[:4] != SEGMENT_MAGIC:
        raise Corrupted("not a segment")
    at = 4
    while True:
        if at + 12 > len(data):
            raise Corrupted(f"cut short at {at}")
        version, n = struct.unpack_from(">QI", data, at)
        if version == END_VERSION:
            return
        payload = data[at + 12 : at + 12 + n]
        if at + 16 + n > len(data) or zlib.crc32(payload) != struct.unpack_from(">I", data, at + 12 + n)[0]:
            raise Corrupted(f"bad record at {at}")
        yield version, payload
        at += 16 + n


def write_chunk(records: list[tuple[int, bytes]]) -> bytes:
    """Records in version order."""
    if not records or any(a[0] >= b[0] for a, b in zip(records, records[1:])):
        raise ValueError("a chunk holds records of increasing versions")
    directory, at = [], 0
    for version, payload in records:
        directory.append(struct.pack(">QII", version, at, len(payload)))
        at += len(payload)
    head = _HEADER.pack(CHUNK_MAGIC, FORMAT_VERSION, 0, 0, records[0][0], records[-1][0], len(records), 16 * len(records))
    return b"".join([head, *directory, *(p for _, p in records)])


def chunk_header(data: bytes) -> dict:
    """min_version, max_version, n of a chunk."""
    if len(data) < _HEADER.size:
        raise Corrupted("cut short")
    magic, fmt, _, _, low, high, n, size = _HEADER.unpack_from(data)
    if magic != CHUNK_MAGIC or fmt != FORMAT_VERSION or size != 16 * n:
        raise Corrupted("not a chunk")
    return {"min_version": low, "max_version": high, "n": n}


def read_chunk(data: bytes, at_least: int = 0) -> Iterator[tuple[int, bytes]]:
    """Records from version at_least on, found by bisection in the directory."""
    n = chunk_header(data)["n"]
    entry = lambda i: struct.unpack_from(">QII", data, _HEADER.size + 16 * i)
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if entry(mid)[0] < at_least else (low, mid)
    base = _HEADER.size + 16 * n
    for i in range(low, n):
        version, at, size = entry(i)
        if base + at + size > len(data):
            raise Corrupted("cut short")
        yield version, data[base + at : base + at + size]


def write_payload(sections: dict[int, bytes]) -> bytes:
    out = [struct.pack(">IBBH", PAYLOAD_MAGIC, FORMAT_VERSION, 0, len(sections))]
    for tag, body in sections.items():
        head = bytes([tag]) + len(body).to_bytes(3, "big")
        out += [head, struct.pack(">I", zlib.crc32(head + body)), body]
    return b"".join(out)


def read_payload(data: bytes, only: set[int] | None = None) -> dict[int, bytes]:
    """Sections by tag, `only` some of them; every section read is checked."""
    if len(data) < 8 or struct.unpack_from(">IB", data) != (PAYLOAD_MAGIC, FORMAT_VERSION):
        raise Corrupted("not a payload")
    count, at, out = struct.unpack_from(">H", data, 6)[0], 8, {}
    for _ in range(count):
        if at + 8 > len(data):
            raise Corrupted("cut short")
        tag, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 8 : at + 8 + n]
        if len(body) != n:
            raise Corrupted("cut short")
        if only is None or tag in only:
            if zlib.crc32(data[at : at + 4] + body) != struct.unpack_from(">I", data, at + 4)[0]:
                raise Corrupted(f"bad section {tag}")
            out[tag] = body
        at += 8 + n
    return out


def load(spark: SparkSession, path: str | list[str], kind: str = "segment", at_least: int = 0) -> DataFrame:
    """path, version, payload, error of the records of all files at path. A file that is corrupted gives its
    records up to there, then a row with the error."""
    read = read_segment if kind == "segment" else lambda data: read_chunk(data, at_least)

    def records(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    for version, payload in read(data.as_py()):
                        if version >= 2**63:
                            raise Corrupted(f"version {version} is beyond the longs")
                        if version >= at_least:
                            rows.append((name, version, payload, None))
                except Corrupted as e:
                    rows.append((name, None, None, str(e)))
                for i in range(0, len(rows), 4096):
                    cols = list(zip(*rows[i : i + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["path", "version", "payload", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(records, "path string, version long, payload binary, error string")
