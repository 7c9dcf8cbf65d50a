"""Secrets in texts: assignments, access keys and hex runs by pattern, keys and signed tokens by their structure.

What looks encoded is decoded and parsed before it counts. Kinds that structure confirms:

* der: base64 or hex of a private key as nested lengths spell it out. RSA and DSA keys are sequences of whole numbers (the
  modulus has to be the product of its factors), elliptic-curve keys a version and a secret of a curve's size, PKCS #8 an
  algorithm with a key of its own in it, sealed PKCS #8 and PKCS #12 an encryption scheme or contents by their names.
* openssh: base64 of a private key file whose nested strings end where it does.
* pem: an armoured block that says PRIVATE KEY, whose body is one of these, or is sealed as its headers say, or holds the
  packets of a secret key.
* jwt: three (signed) or five (sealed) parts of base64url; the header is an object with an algorithm, the payload an object, and
  the signature has the algorithm's size. Tokens without a signature are no secret.

A text is scanned by the task that reads it; nothing is shuffled. Places are code points, ends exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows are repeated; a text of any length is scanned whole;
structures that overlap one of a larger kind (pem, then der and openssh, then jwt) are given once, under that kind.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches_of, small_batches, table, unused

#: The kinds of spans, as they are listed at a place; the first three are patterns.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
BASE = KINDS[:3]

# The base patterns, and how long a value, an access key and a hex run are at least.
_ASSIGN = re.compile(
    rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_VALUE_LEAST, _ACCESS_LEAST, _HEX_LEAST = 12, 18, 16
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]{%d,}" % _HEX_LEAST)
_WORDS = (b"passw", b"secret", b"token", b"api")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_ARMOUR = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
#: Lines of base64 of either alphabet, the first of 40 characters or more; a key has more.
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{40,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*={0,2}")
_HEX_KEY = re.compile(rb"[0-9A-Fa-f]{80,}")
#: A header starts with a brace and a quote, blank or line end.
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]*){2,4}(?![A-Za-z0-9_-])")
_SEQUENCE, _OPENSSH = re.compile(rb"M[A-I]"), b"b3BlbnNzaC1rZXktdjEA"

# Fixed values of the encodings.
_SIGNATURES = {
    "HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114},
    **{f"{kind}{bits}": set(range(128, 1025, 8)) for kind in ("RS", "PS") for bits in (256, 384, 512)},
}
_RSA, _EC, _DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
_CURVE_25519, _CURVE_448 = (bytes.fromhex("2b656e"), bytes.fromhex("2b6570")), (bytes.fromhex("2b656f"), bytes.fromhex("2b6571"))
_SEALED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_CONTENTS = bytes.fromhex("2a864886f70d0107")
_INTEGER, _BITS, _OCTETS, _OID, _LIST, _FIELD_0, _FIELD_1 = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the element at a place, if its length fits before the end and is written in as few
    bytes as it needs."""
    if at + 2 > min(end, len(data)):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or at + more > end:
            return None
        size = int.from_bytes(data[at : at + more], "big")
        if size < 0x80 or size < 1 << (8 * (more - 1)):
            return None
        at += more
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the elements that fill a stretch."""
    out = []
    while at < end:
        found = element(data, at, end)
        if found is None:
            return None
        tag, start, at = found
        out.append((tag, data[start:at]))
    return out


def _inside(data: bytes, tag: int = _LIST) -> list[tuple[int, bytes]] | None:
    """What the one element that data is has in it."""
    found = element(data, 0, len(data))
    return elements(data, found[1], len(data)) if found and found[0] == tag and found[2] == len(data) else None


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are a private key whose nested lengths and fields agree."""
    parts = _inside(data)
    if not parts:
        return False
    tags = [tag for tag, _ in parts]
    if tags[0] == _LIST and tags == [_LIST, _OCTETS]:  # sealed PKCS #8
        scheme = elements(parts[0][1], 0, len(parts[0][1]))
        return bool(scheme) and scheme[0][0] == _OID and scheme[0][1].startswith(_SEALED) and len(parts[1][1]) >= 16 and len(parts[1][1]) % 8 == 0
    if tags[0] != _INTEGER:
        return False
    version = _number(parts[0][1])
    if set(tags) == {_INTEGER}:
        n = [_number(x) for _, x in parts]
        if len(n) == 9 and version == 0:
            return n[1].bit_length() >= 512 and n[4] > 1 and n[4] * n[5] == n[1]
        return len(n) == 6 and version == 0 and n[1].bit_length() >= 512 and n[2] > 1 and (n[1] - 1) % n[2] == 0 and 0 < n[5] < n[2]
    if version == 1 and tags[1] == _OCTETS and set(tags[2:]) <= {_FIELD_0, _FIELD_1}:
        return 16 <= len(parts[1][1]) <= 72 and all(elements(x, 0, len(x)) for _, x in parts[2:])
    if version in (0, 1) and tags[1:3] == [_LIST, _OCTETS]:  # PKCS #8
        name, key = elements(parts[1][1], 0, len(parts[1][1])), parts[2][1]
        if not name or name[0][0] != _OID:
            return False
        name = name[0][1]
        if name in (_RSA, _EC):
            return is_private_key(key)
        whole = element(key, 0, len(key))
        if whole is None or whole[2] != len(key):
            return False
        size = whole[2] - whole[1]
        if name in _CURVE_25519 + _CURVE_448:
            return whole[0] == _OCTETS and size in ((32,) if name in _CURVE_25519 else (56, 57))
        return name == _DSA and whole[0] == _INTEGER
    if version == 3 and tags[1] == _LIST:  # PKCS #12
        name = elements(parts[1][1], 0, len(parts[1][1]))
        return bool(name) and len(name) == 2 and name[0][0] == _OID and name[0][1].startswith(_CONTENTS) and name[1][0] == _FIELD_0
    return False


def openssh_end(data: bytes) -> int | None:
    """Where a private key file ends that the bytes begin with."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, held = len(magic), []

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):
        held.append(string())
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if None in held or not 1 <= n <= 256:
        return None
    if any(string() is None for _ in range(n)):
        return None
    sealed = string()
    if sealed is None or len(sealed) < 16 or len(sealed) % 8 or (held[0] == b"none" and sealed[:4] != sealed[4:8]):
        return None
    return at


def _is_secret_packets(data: bytes) -> bool:
    """Whether the bytes are packets, the first of a secret key, that end where they do."""
    at, first = 0, True
    while at < len(data):
        head, at = data[at], at + 1
        if not head & 0x80 or at >= len(data):
            return False
        if head & 0x40:
            tag, size = head & 0x3F, data[at]
            if size < 192:
                at += 1
            elif size < 224:
                size, at = ((size - 192) << 8) + int.from_bytes(data[at + 1 : at + 2], "big") + 192, at + 2
            elif size == 255:
                size, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            else:
                return False
        else:
            tag, width = (head >> 2) & 15, (1, 2, 4, 0)[head & 3]
            size = int.from_bytes(data[at : at + width], "big") if width else len(data) - at
            at += width
        if first and tag != 5 or at + size > len(data):
            return False
        at, first = at + size, False
    return not first


def _decoded(chars: bytes) -> bytes:
    """Bytes of base64 of either alphabet without padding; what is left over of a group of four is dropped if it can't be one."""
    chars = chars.translate(bytes.maketrans(b"-_", b"+/"), b"\r\n =")
    chars = chars[: len(chars) - (len(chars) % 4 == 1)]
    return base64.b64decode(chars + b"=" * (-len(chars) % 4))


def is_armoured(label: bytes, body: bytes) -> bool:
    """Whether an armoured body is the private key that its label says."""
    head, blank, rest = body.replace(b"\r\n", b"\n").lstrip(b"\n").partition(b"\n\n")
    headers, chars = (head, rest) if blank and b":" in head else (b"", head + rest)
    if label.endswith(b"BLOCK"):
        chars = re.sub(rb"\n=[A-Za-z0-9+/]{4}\s*$", b"", chars)
    chars = b"".join(chars.split())
    if not re.fullmatch(rb"[A-Za-z0-9+/]+={0,2}", chars):
        return False
    data = _decoded(chars)
    if label.endswith(b"BLOCK"):
        return _is_secret_packets(data)
    if b"DEK-Info:" in headers:
        return len(data) >= 16 and len(data) % 8 == 0
    return is_private_key(data) or openssh_end(data) == len(data)


def is_token(parts: list[bytes]) -> bool:
    """Whether the parts are those of a signed or sealed token."""
    try:
        header = json.loads(_decoded(parts[0]))
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if len(parts) == 5:
            return isinstance(header.get("enc"), str) and all(parts[k] for k in (2, 3, 4))
        return len(parts) == 3 and isinstance(json.loads(_decoded(parts[1])), dict) and len(_decoded(parts[2])) in _SIGNATURES.get(header["alg"], ())
    except (ValueError, RecursionError):
        return False


def _at_byte(found: re.Match, n: int) -> int:
    """The place of the n-th character of a match that isn't a line end."""
    text, base = found[0], found.start()
    if b"\n" not in text:
        return base + n
    places = np.flatnonzero(~np.isin(np.frombuffer(text, dtype=np.uint8), (10, 13)))
    return base + (int(places[n]) if n < len(places) else len(text))


def _encoded_keys(text: bytes) -> Iterator[tuple[str, int, int]]:
    """Keys in base64 and in hex, by bytes of the text. Of a run every place is tried where a key can start."""
    for found in _BASE64.finditer(text):
        chars, done = found[0].translate(None, b"\r\n"), 0
        starts = sorted([m.start() for m in _SEQUENCE.finditer(chars)] + [m.start() for m in re.finditer(_OPENSSH, chars)])
        for start in starts:
            if start < done:
                continue
            if chars.startswith(_OPENSSH, start):
                size, kind = openssh_end(_decoded(chars[start:].rstrip(b"="))), "openssh"
            else:
                head = element(_decoded(chars[start : start + 8]), 0, 1 << 40)
                size, kind = (head[2] if head and head[2] <= (len(chars) - start) * 3 // 4 else None), "der"
                if size and not is_private_key(_decoded(chars[start : start + -(-size * 4 // 3)])[:size]):
                    size = None
            if size:
                done = start + -(-size * 4 // 3)
                last = _at_byte(found, done - 1) + 1
                while last < len(text) and text[last : last + 1] == b"=" and last - _at_byte(found, done - 1) <= -size % 3:
                    last += 1
                yield kind, _at_byte(found, start), last
    for found in _HEX_KEY.finditer(text):
        chars, done = found[0], 0
        for m in re.finditer(rb"(?=30)", chars):
            start = m.start()
            if start < done:
                continue
            head = element(bytes.fromhex(chars[start : start + 12].decode()), 0, 1 << 40) if start + 12 <= len(chars) else None
            if head and 2 * head[2] <= len(chars) - start and is_private_key(bytes.fromhex(chars[start : start + 2 * head[2]].decode())):
                done = start + 2 * head[2]
                yield "der", found.start() + start, found.start() + done


def _free(found: Iterable[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those found that overlap none of the taken, which don't overlap each other."""
    ranges = sorted((a, b) for _, a, b in taken)
    starts, out = [a for a, _ in ranges], []
    for x in found:
        i = bisect_right(starts, x[1])
        if (not i or ranges[i - 1][1] <= x[1]) and (i == len(ranges) or ranges[i][0] >= x[2]):
            out.append(x)
    return out


def spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    out: list[tuple[str, int, int]] = []
    low = text.translate(_LOWER)
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _VALUE_LEAST]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _ACCESS_LEAST]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    more: list[tuple[str, int, int]] = []
    if b"PRIVATE KEY" in text:
        more += [("pem", *m.span()) for m in _ARMOUR.finditer(text) if is_armoured(m[1], m[2])]

    more += _free(_encoded_keys(text), more)
    if b"." in text:
        more += _free((("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_token(m[0].split(b"."))), more)
    out += more
    if out and not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
        out = [(kind, int(points[a]), int(points[b])) for kind, a, b in out]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS)])

    def run(batches):
        rows = (
            (doc, [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(text.as_buffer().to_pybytes())] if text.is_valid else [])
            for batch in batches
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True)
        )
        return batches_of(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {_SPAN}")


def masked(text: str, mask: str) -> tuple[str, int]:
    """A text with a mask for each stretch that spans cover together, and their number."""
    out, end, n = [], 0, 0
    for _, a, b in spans(text.encode()):
        if n == 0 or a >= end:
            out += [text[end:a], mask]
            n += 1
        end = max(end, b)
    return "".join([*out, text[end:]]), n


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with its text masked, and one more column n_secrets (with underscores appended, if it is taken): how many stretches
    went. Null texts stay null."""
    small_batches(docs.sparkSession)
    (name,) = unused(docs.columns, "n_secrets")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [(None, 0) if x is None else masked(x, mask) for x in batch.column(at).to_pylist()]
            columns = [pa.array([t for t, _ in found], batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in found], pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _joined(some: Column) -> Column:
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count_of(some: Column, kind: str) -> Column:
    return F.size(F.filter(some, lambda s: s["kind"] == kind)).cast("long")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.col("spans")
    found = scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", every.alias("every"), F.filter(every, lambda s: s["kind"].isin(*BASE)).alias("base"), F.filter(every, lambda s: ~s["kind"].isin(*BASE)).alias("more")
    )
    base, more = F.col("base"), F.col("more")
    confirmed = F.filter(base, lambda s: F.exists(more, lambda m: (m["start"] < s["end"]) & (s["start"] < m["end"])))
    return found.select(
        "doc_id", *(_count_of(base, kind).alias(f"n_{kind}") for kind in BASE), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"), F.size("more").cast("long").alias("n_structures"), F.size(confirmed).cast("long").alias("n_confirmed"),
    )
