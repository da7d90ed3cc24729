"""Secret scans with structural confirmation."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.common import batch_slices, frugal
from gristmill.llm.spans import SPAN, report

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "private_key", "signed_token")
RANK = {k: i for i, k in enumerate(KINDS)}

#: The patterns of the base kinds. Of a whole run, only its length is asked for.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates for decoding.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}+(?![0-9A-Fa-f])")
ARMOURED = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]{40,}+)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
OPENSSH = b"openssh-key-v1\0"


def decoded(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, with or without padding."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER elements that fill data exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_der_key(data: bytes) -> bool:
    """A private key: version, then RSA numbers, an algorithm with a wrapped key, or an EC value."""
    top = elements(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = elements(top[0][1])
    if not inner or inner[0][0] != 0x02 or len(inner) < 2:
        return False
    version, tags = inner[0][1], [t for t, _ in inner]
    if version == b"\0" and len(inner) >= 9 and tags[:9] == [0x02] * 9:
        return True
    if version in (b"\0", b"\1") and tags[1] == 0x30 and len(inner) >= 3 and tags[2] == 0x04:
        algorithm = elements(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return version == b"\1" and tags[1] == 0x04 and len(inner[1][1]) in (20, 24, 28, 32, 48, 66)


def is_encrypted_key(data: bytes) -> bool:
    """An algorithm (identifier and parameters) and an octet string, as in an encrypted private key."""
    top = elements(data)
    inner = elements(top[0][1]) if top and len(top) == 1 and top[0][0] == 0x30 else None
    if not inner or [t for t, _ in inner] != [0x30, 0x04] or len(inner[1][1]) < 32:
        return False
    algorithm = elements(inner[0][1])
    return bool(algorithm) and len(algorithm) == 2 and [t for t, _ in algorithm] == [0x06, 0x30] and bool(elements(algorithm[1][1]))


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, derivation, options, a key count, and as many length-prefixed blobs."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def blob() -> bytes | None:
        nonlocal at
        length = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + length > len(data):
            return None
        at += 4 + length
        return data[at - length : at]

    if any(blob() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(blob() for _ in range(keys + 1))


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_encrypted_key(data) or is_openssh_key(data))


def is_signed_token(text: str) -> bool:
    """Header and claims are JSON objects, the header names an algorithm, and the signature fits it."""
    head, claims, signature = text.split(".")
    try:
        header, body = (json.loads(decoded(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(body, dict) or not isinstance(header.get("alg"), str):
        return False
    return not signature if header["alg"].lower() == "none" else len(signature) >= 32 and decoded(signature) is not None


#: An encoding may stand in an encoding: base64 of base64 of an armoured key is at depth 3.
DEPTH = 3
#: The first bytes of what is looked into further: a sequence, the OpenSSH container, or text.
TEXT = frozenset((*b"\t\n\r", *range(0x20, 0x7F)))


def confirmed(text: str, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """(kind, start, end) of keys and tokens, as they stand or inside base64 or hex, up to ``depth`` encodings deep; none overlap.

    What is decoded is parsed as a key; where it is text it is searched in turn. Each encoding
    shortens, so time is in proportion to the text.
    """
    sure: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []  # in order of start

    def add(kind: str, start: int, end: int) -> None:
        at = bisect_left(taken, (start, start))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            sure.append((kind, start, end))

    def inside(data: bytes | None) -> str | None:
        if not data:
            return None
        if is_key(data):
            return "private_key"
        if depth > 1 and len(data) >= 40 and TEXT.issuperset(data[:64]) and TEXT.issuperset(data):
            found = confirmed(data.decode("ascii"), depth - 1)
            return found[0][0] if found else None
        return None

    if "-----BEGIN " in text:
        for m in ARMOURED.finditer(text):
            if is_key(decoded("".join(m[2].split()))):
                add("private_key", *m.span())
    if "ey" in text and "." in text:
        for m in TOKEN.finditer(text):
            if is_signed_token(m[0]):
                add("signed_token", *m.span())
    for m in ENCODED.finditer(text):
        if kind := inside(decoded(m[0])):
            add(kind, *m.span())
    for m in HEX_BYTES.finditer(text):
        if kind := inside(bytes.fromhex(m[0])):
            add(kind, *m.span())
    return sure


def scan(text: str) -> list[tuple[int, int, str, int, str]]:
    """Sorted spans of the base kinds and of what decoding confirms; confirmed ones don't overlap each other."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted((a, RANK[k], k, b, text[a:b]) for k, a, b in found + confirmed(text))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """One row per document: its id and the sorted spans of secrets in its whole text.

    The base kinds are found by pattern. Base64 runs, hex runs, armoured blocks and dotted tokens
    are decoded and reported only where they parse as a private key (DER with nested lengths that
    fit, encrypted or not, or the OpenSSH container) or as a signed token; what decodes to text is
    searched in turn, up to DEPTH encodings deep. Null or empty text has none; null ids and
    repeated rows stay as they are. Patterns take time in proportion to the text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch):
                rows = [
                    [dict(zip(("start", "rank", "kind", "end", "found"), s)) for s in scan(text)] if text else [] for text in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, type=SPANS)], names=[id_col, out_col])

    return docs.select(id_col, text_col).mapInArrow(frugal(run), f"{id_col} {kind}, {out_col} array<{SPAN}>")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("found", pa.string())]))


def documents_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: secrets in all documents."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), out_col="found")
    return found.select("doc_id", *report("found", BASE))
