"""Secret scan with structural confirmation.

Patterns give the base spans. Beyond them, every base64 or hex candidate is decoded and its content parsed: a signed
token must have a JSON header that names an algorithm, a key must be a DER structure whose nested lengths add up and whose
elements are those of a private key, or carry the framing of a private key file. Only candidates whose structure is confirmed
are reported; public keys and certificates are not secrets.

Defined cases: a null or empty text has no spans; texts are read whole, whatever their length; repeated rows each get their
own result; spans that begin together are ordered by kind as listed, then end; positions are code points; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import base_digest, count_kind, find_spans, spelled, two_columns

KINDS = ("assign", "access", "hex", "der", "encoded", "pem", "signed", "sshkey")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{32,}+")
#: Runs that can hold an encoded structure; dots join the parts of signed tokens.
RUN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*+(?:\.[A-Za-z0-9_-]++=*+)*+")
#: What maps a byte of a run to x, so that a long run is found by a plain search.
MARK = bytes(120 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 32 for c in range(256))
HEXMARK = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*+)-----((?:[A-Za-z0-9+/=\s]|\\[nr]){16,}+)-----END \1-----")
#: Where a structure may begin within a run that is glued to something else.
INNER = re.compile(rb"(?<=/)|(?=eyJ|MII)")
MAGIC = b"openssh-key-v1\0"
#: How often what a run decodes to may be encoded again.
LAYERS = 2


def der(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Where the content of the DER element at ``at`` begins and ends, if it lies before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    if at + size > end or tag & 0x1F in (0, 0x1F) and not tag & 0xC0:
        return None
    return at, at + size


def elements(data: bytes) -> list[tuple[int, int, int]] | None:
    """Tag, begin and end of what the one SEQUENCE that fills ``data`` holds, if all nested lengths add up."""
    whole = der(data, 0, len(data)) if data[:1] == b"\x30" else None
    if whole is None or whole[1] != len(data):
        return None
    found, open_ = [], [whole]
    while open_:
        at, end = open_.pop()
        while at < end:
            inner = der(data, at, end)
            if inner is None:
                return None
            if data[at] & 0x20:
                open_.append(inner)
            at = inner[1]
    at = whole[0]
    while at < whole[1]:
        inner = der(data, at, whole[1])
        found.append((data[at], *inner))
        at = inner[1]
    return found


def key_der(data: bytes) -> bool:
    """The elements of a private key: a version of 0 or 1 before two others or more, or an algorithm and an encrypted key."""
    found = elements(data) if len(data) >= 16 else None
    if not found:
        return False
    tag, at, end = found[0]
    if tag == 0x02 and end - at == 1 and data[at] in (0, 1):
        return len(found) >= 3 or len(found) == 2 and found[1][0] == 0x04
    return [f[0] for f in found] == [0x30, 0x04]


def key_ssh(data: bytes) -> bool:
    """The framing of a private key file: its name, then the lengths of cipher, key derivation and options fit."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)
    for _ in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at <= len(data)


def base64_bytes(run: bytes) -> bytes | None:
    run = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def signed(run: bytes) -> bool:
    """Three parts of which the first decodes to a JSON object with an algorithm, the second to an object."""
    parts = run.split(b".")
    if len(parts) != 3:
        return False
    try:
        head = json.loads(base64_bytes(parts[0]) or b"0")
        body = json.loads(base64_bytes(parts[1]) or b"0")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def structure(run: bytes, depth: int = LAYERS) -> str | None:
    """The kind of secret that a run decodes to, or None."""
    if signed(run):
        return "signed"
    if b"." in run:
        return None
    found = [base64_bytes(run)]
    if len(run) % 2 == 0 and re.fullmatch(rb"[0-9a-fA-F]+", run):
        found.insert(0, bytes.fromhex(run.decode()))
    for data in found:
        if data is None:
            continue
        if key_ssh(data):
            return "sshkey"
        if key_der(data):
            return "der"
        if data.startswith(b"-----BEGIN ") and b"PRIVATE KEY-----" in data:
            return "pem"
        if depth and data.isascii():
            if any(len(m[2]) >= 8 for m in ASSIGN.finditer(data)) or any(len(m[0]) >= 16 for m in ACCESS.finditer(data)):
                return "encoded"
            if any(structure(m[0], depth - 1) for m in RUN.finditer(data)):
                return "encoded"
    return None


def likely(run: bytes, at: int) -> bool:
    """Whether the bytes at ``at`` can open a structure; spares decoding each rest of a long run."""
    head = run[at : at + 24].split(b".")[0]
    data = base64_bytes(head[: len(head) // 4 * 4]) or b""
    return len(run) - at >= 16 and (data[:1] == b"0" or data[:3] == b"\0\0\0" or data.isascii() or re.fullmatch(rb"[0-9a-fA-F]{8,}", head) is not None)


def structures(run: bytes) -> list[tuple[str, int, int]]:
    """Kind, start and end of what a run holds: the whole run, or structures that begin or end within it."""
    if kind := structure(run):
        return [(kind, 0, len(run))]
    out, end = [], 0
    for at in [0, *(m.start() for m in INNER.finditer(run))]:
        if at < end or not likely(run, at):
            continue
        parts = run[at:].split(b".", 3)
        for some in dict.fromkeys((b".".join(parts[:3]), parts[0])):
            if some != run and len(some) >= 16 and (kind := structure(some)):
                end = at + len(some)
                out.append((kind, at, end))
                break
    return out


def spans_of(text: str) -> list[tuple]:
    """(kind, start, end, base, score) by start, then kind in the order of KINDS."""
    raw = text.encode("ascii", "replace")  # one byte for each code point; '?' is in no pattern
    out = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end(), True, 1.0) for m in ASSIGN.finditer(raw) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end(), True, 1.0) for m in ACCESS.finditer(raw) if len(m[0]) >= 16]
    if b"x" * 32 in raw.translate(HEXMARK):
        out += [("hex", m.start(), m.end(), True, 1.0) for m in HEX.finditer(raw)]
    if b"x" * 16 in raw.translate(MARK):
        out += [(kind, m.start() + s, m.start() + e, False, 1.0) for m in RUN.finditer(raw) for kind, s, e in structures(m[0])]
    if b"-----BEGIN " in raw:
        for m in PEM.finditer(raw):
            data = base64_bytes(re.sub(rb"\\[nr]|\s", b"", m[2]))
            if data and (key_der(data) or key_ssh(data)):
                out.append(("pem", m.start(), m.end(), False, 1.0))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, base, score) of every text, one narrow pass without a shuffle."""
    return find_spans(two_columns(df, id_col, text_col), lambda: spans_of)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[count_kind(k) for k in ("assign", "access", "hex")], base_digest(), spelled("spans").alias("spans"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text"))))
