"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Each byte is one printable character; a vocabulary entry becomes the piece of its bytes' characters
with the score -rank, so the best-scored merge is the merge of lowest rank. Normalisation is the
identity and no space is added, so a pre-token's bytes reach the model as they are. Decoding maps
each id back to its piece and each character back to its byte.

Defined results: a null text counts as empty (no ids, no bytes); a very long text is encoded whole, its words one
by one; ties cannot arise, as every rank is one piece's; repeated rows each give a row; an empty table gives an empty result; other columns are ignored, and the result's names win over theirs.
"""
from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import Cache, pieces
from .common import slices

_WORKER: dict = {}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        entries = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(entries)
    for token, rank in entries:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: tokens by rank, then the unknown piece the format asks for."""
    chars = byte_characters()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _flag(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, 2)))
    trainer = _flag(3, 2) + _flag(4, len(tokens) + 1) + _flag(40, len(tokens))
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no begin, end or padding: -1
    normal = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normal)


class Codec:
    def __init__(self, model: bytes, pattern: str, most: int = 800_000):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        chars = byte_characters()
        self.chars = chars
        self.to_char = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        unk = self.sp.unk_id()
        self.bytes_of = [b"" if i == unk else bytes(back[c] for c in self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())]
        self.packed: dict[str, bytes] = {}
        self.most = most
        self.cache = Cache(self.encode_pieces, most=most)

    def _mapped(self, s: str) -> str:
        return s.encode().decode("latin-1").translate(self.to_char)

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, pre-token by pre-token."""
        found = [self.find(x) for x in texts]
        need = {p for f in found for p in f} - self.packed.keys()
        if len(self.packed) + len(need) > self.most:
            self.packed = {}
            need = {p for f in found for p in f}
        new = list(need)
        if new:
            for p, ids in zip(new, self.sp.encode([self._mapped(p) for p in new], out_type=int, num_threads=1), strict=True):
                self.packed[p] = struct.pack(f"<{len(ids)}i", *ids)
        get = self.packed.__getitem__
        out = [b"".join(map(get, f)) for f in found]
        for p in new:
            if len(p) > 64:
                del self.packed[p]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [pieces(x) for x in texts]
        drop = self.cache.fill(cut)
        get = self.cache.known.__getitem__
        heads = self.encode_pieces([c[0] for c in cut])
        out = [h + b"".join(map(get, c[1:])) for c, h in zip(cut, heads, strict=True)]
        self.cache.forget(drop)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int) and decoded (binary, from the ids) of each row."""
    made_of = model_bytes(read_ranks(ranks_path))
    model, name = docs.sparkSession.sparkContext.broadcast(made_of), (hashlib.sha256(made_of).hexdigest(), pattern)

    def run(batches):
        made = _WORKER.get("codec")
        if made is None or made[0] != name:
            made = _WORKER["codec"] = (name, Codec(model.value, pattern))
        codec = made[1]
        for batch in slices(batches, 128):
            packed = codec.encode([x or "" for x in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), np.int32)
            decoded = [codec.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
