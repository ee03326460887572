"""Secrets in texts: pattern spans, and candidates confirmed by what they decode to.

Base kinds, leftmost and non-overlapping each: assign (a name, : or =, a value of 12 or more),
access (AKIA key ids of 18 or more), hex (runs of 16 or more lower-case hex digits).
Structural kinds, reported only once the decoded bytes parse:
- der: base64 or hex of a DER private key; every nested length must fill its parent exactly, that of a
  wrapped key's inner key too. A candidate begins where the first bytes can be those of a key, also in the middle of a
  run of characters, and ends where its outermost length says; base64 may be wrapped in lines.
- ssh: base64 of an OpenSSH private key; magic, then length-prefixed fields, found and wrapped likewise.
- jwt: three base64url parts, a JSON header that names an algorithm, a JSON object as payload.
- pem: a BEGIN ... PRIVATE KEY block whose body decodes to one of the above, or to an encrypted key: a DER sequence of
  an algorithm and octets, or, below RFC 1421 headers that name a cipher and its initial vector, whole cipher
  blocks. Line ends may be escaped, as in JSON or code.

Defined results: a null or empty text has no spans; a very long text is scanned whole, with one pass a pattern;
spans of one start come in the order of the kinds, then by end; repeated rows each give a row; an empty table
gives an empty result; other columns are ignored. Offsets count code points, ends are exclusive.
"""
from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

#: The base kinds in their order, then those the method adds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "der", "ssh", "jwt", "pem")

_NAMES = ("passw", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_B64 = "[A-Za-z0-9+/_-]"
# a sequence (30, then a length of one, two or three bytes) that starts with a one-byte number below 4, or the magic of OpenSSH
_STARTS64 = re.compile(rf"M(?:[A-H][AEIMQUYcgkosw048]CAQ[A-P]|I[E-H]{_B64}AgE[A-P]|I[I-L]{_B64}{{2}}[AQgw]IBA)|b3BlbnNzaC1rZXktdjEA")
_STARTS16 = re.compile(r"30(?:82[0-9a-f]{4}|81[0-9a-f]{2}|[0-7][0-9a-f])02010[0-3]", re.I)
_RUN64 = re.compile(rf"{_B64}+(?:(?:[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*){_B64}+)*")
_RUN16 = re.compile(r"(?:[0-9A-Fa-f]{2})+")
_LINES = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])e(?:yJ|yA|wo|w0|wk)[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
# a body goes on to the next BEGIN or END, so that blocks without an END cost no more than their length
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]++|-(?!----(?:BEGIN|END) ))*+)-----END \1-----")
#: Fixed value: what an OpenSSH private key starts with.
_SSH_MAGIC = b"openssh-key-v1\x00"


def decode64(s: str) -> bytes | None:
    s = re.sub(r"[\x09-\x0d\x20]", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at `at`, or None if it leaves its parent."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or b[at] == 0:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _members(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        e = _element(b, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def _fills(b: bytes, at: int, end: int, depth: int = 8) -> bool:
    """Whether [at, end) is elements end to end, and the contents of each constructed one likewise."""
    m = _members(b, at, end) if depth else None
    return m is not None and all(_fills(b, s, e, depth - 1) for tag, s, e in m if tag & 0x20)


def is_der_key(b: bytes) -> bool:
    """A DER private key: RSA (nine integers), DSA (six, version 0), EC (version, octets) or wrapped (version, algorithm, a key)."""
    top = _element(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b) or not _fills(b, top[1], top[2]):
        return False
    m = _members(b, top[1], top[2])
    if not m or m[0][0] != 2 or m[0][2] - m[0][1] != 1:
        return False
    tags = [x[0] for x in m]
    if tags == [2] * 9 or (tags[:9] == [2] * 9 and tags[9:] == [0x30]) or (tags == [2] * 6 and b[m[0][1]] == 0):
        return True
    if tags[:2] == [2, 4] and set(tags[2:]) <= {0xA0, 0xA1}:
        return m[1][2] - m[1][1] >= 16
    if tags[:3] == [2, 0x30, 4] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        algorithm = _members(b, m[1][1], m[1][2])
        return bool(algorithm) and algorithm[0][0] == 6 and _is_inner_key(b[m[2][1] : m[2][2]])
    return False


def _is_inner_key(b: bytes) -> bool:
    """What a wrapped key holds: a key of its own form, or one string of octets or one integer."""
    one = _element(b, 0, len(b))
    return one is not None and one[2] == len(b) and (is_der_key(b) or (one[0] in (2, 4) and one[2] - one[1] >= 16))


def is_encrypted_der(b: bytes | None) -> bool:
    """A DER sequence of an algorithm (an object id and its parameters) and the encrypted octets."""
    top = _element(b, 0, len(b)) if b else None
    if top is None or top[0] != 0x30 or top[2] != len(b) or not _fills(b, top[1], top[2]):
        return False
    m = _members(b, top[1], top[2])
    if [x[0] for x in m or []] != [0x30, 4] or m[1][2] - m[1][1] < 16:
        return False
    algorithm = _members(b, m[0][1], m[0][2])
    return [x[0] for x in algorithm or []] == [6, 0x30]


def ssh_end(b: bytes) -> int | None:
    """Where an OpenSSH private key ends: magic, three strings, a count of 1 or more, that many public parts and a private one."""
    if not b.startswith(_SSH_MAGIC):
        return None
    at = len(_SSH_MAGIC)

    def string(at: int) -> int:
        if at < 0 or at + 4 > len(b):
            return -1
        end = at + 4 + int.from_bytes(b[at : at + 4], "big")
        return end if end <= len(b) else -1

    for _ in range(3):
        at = string(at)
    if at < 0 or at + 4 > len(b) or not 0 < (n := int.from_bytes(b[at : at + 4], "big")) <= 64:
        return None
    at += 4
    for _ in range(n + 1):
        at = string(at)
    return at if at > 0 else None


def is_ssh_key(b: bytes) -> bool:
    return ssh_end(b) == len(b)


def key_length(b: bytes) -> int | None:
    """How many bytes the key that b starts with says it has."""
    if b[:1] == b"\x30":
        n = b[1] if len(b) > 1 else 0
        k = n & 0x7F if n & 0x80 else 0
        return 2 + n if not k else 2 + k + int.from_bytes(b[2 : 2 + k], "big")
    return ssh_end(b)


def is_signed_token(s: str) -> bool:
    """Three parts; the header and the payload are JSON objects and the header names an algorithm."""
    head, body, sign = s.split(".")
    try:
        h, p = (json.loads(decode64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(p, dict) and isinstance(h.get("alg"), str) and (bool(sign) or h["alg"] == "none")


def key_kind(b: bytes | None) -> str | None:
    if not b:
        return None
    return "der" if is_der_key(b) else "ssh" if is_ssh_key(b) else None


def pem_bodies(body: str) -> list[str]:
    """What may be the base64 of a PEM body: without escapes, then without the lines or the paragraph of headers."""
    body = re.sub(r"\\+r\\+n|\\+[rn]|\r\n?", "\n", body)
    body = re.sub(r"\\+t", "\t", re.sub(r"\\+/", "/", body))
    if ":" not in body:
        return [body]
    lines = [x.strip() for x in body.strip().split("\n")]
    after = lines[lines.index("") + 1 :] if "" in lines else []
    return ["\n".join(x for x in lines if ":" not in x), "\n".join(after)]


def is_encrypted_body(body: str) -> bool:
    """Below headers that name a cipher and its initial vector in hex: base64 of whole blocks of that cipher."""
    plain = re.sub(r"\\+r\\+n|\\+[rn]|\r\n?", "\n", body)
    info = re.search(r"(?m)^\s*DEK-Info:\s*[A-Za-z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})\s*$", plain)
    if not info or not re.search(r"(?m)^\s*Proc-Type:\s*4,\s*ENCRYPTED\s*$", plain):
        return False
    found = [decode64(x) for x in pem_bodies(body)]
    return any(b and len(b) >= 16 and len(b) % (len(info[1]) // 2) == 0 for b in found)


def keys_in_base64(text: str) -> list[tuple[int, int, str]]:
    """Keys from every possible start on, as far as their own lengths say."""
    out, past = [], 0
    for m in _STARTS64.finditer(text):
        at = m.start()
        if at < past:
            continue
        head = decode64(text[at : at + 7])  # what every start has at least
        most = None  # characters that can matter
        if head[:1] == b"\x30":
            n = key_length(head)
            most = -(-4 * n // 3)
        run = _RUN64.match(text, at, len(text) if most is None else min(len(text), at + 2 * most + 200)).group(0)
        lines = _LINES.split(run)
        flat = "".join(lines)
        if most is not None and len(flat) < most:
            continue
        b = decode64(flat[: most or len(flat) // 4 * 4]) if most else decode64(flat if len(flat) % 4 != 1 else flat[:-1])
        n = key_length(b or b"")
        kind = key_kind(b[:n]) if b and n and n <= len(b) else None
        if not kind:
            continue
        chars, end = -(-4 * n // 3), at
        for gap in re.finditer(_LINES.pattern + "|" + _B64 + "+", run):
            if chars <= 0:
                break
            inside = not gap.group(0)[0].isspace() and gap.group(0)[0] != "\\"
            end = at + gap.start() + (min(chars, len(gap.group(0))) if inside else len(gap.group(0)))
            chars -= len(gap.group(0)) if inside else 0
        end += len(re.match("={0,2}", text[end : end + 2]).group(0)) if n % 3 else 0
        out.append((at, end, kind))
        past = end
    return out


def keys_in_hex(text: str) -> list[tuple[int, int, str]]:
    out, past = [], 0
    for m in _STARTS16.finditer(text):
        if m.start() < past:
            continue
        n = key_length(bytes.fromhex(text[m.start() : m.start() + 8]))
        run = _RUN16.match(text, m.start(), min(len(text), m.start() + 2 * n)).group(0)
        if len(run) == 2 * n and (kind := key_kind(bytes.fromhex(run))):
            out.append((m.start(), m.start() + 2 * n, kind))
            past = m.start() + 2 * n
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            bodies = [decode64(x) for x in pem_bodies(m.group(2))]
            if any(key_kind(b) or is_encrypted_der(b) for b in bodies) or is_encrypted_body(m.group(2)):
                out.append((m.start(), m.end(), "pem"))
    out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m.group(0))]
    return out + keys_in_base64(text) + keys_in_hex(text)


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    return sorted({*base_spans(text), *structural_spans(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans, an array of (kind, s, e), of each row."""

    def run(batches):
        for batch in slices(batches):
            found = [[{"kind": k, "s": s, "e": e} for s, e, k in spans_of(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["id", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,s:int,e:int>>").withColumnRenamed("id", id_col)


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each stretch that spans cover (overlapping ones together) replaced by one mark."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for s, e, k in spans:
        if s >= end:
            out += [text[at:s] if s >= at else "", f"<{k}>"]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by its kind in angle brackets; other columns as they are."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            new = pa.array([masked(x, spans_of(x)) for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
