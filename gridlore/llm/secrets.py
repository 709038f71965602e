"""Secret scan with structural confirmation.

Base patterns are reported as they match. Encoded candidates, in base64 (either alphabet, also in lines) or hex, are
reported only if they decode to something that parses to its end: DER private keys by their nested lengths
(PKCS#1, DSA, PKCS#8, encrypted PKCS#8, SEC 1), OpenSSH keys by their length-prefixed fields, PEM blocks by what
they hold (of the old encrypted form by its headers and whole cipher blocks), and signed tokens by header,
payload and the signature length that the header's algorithm asks for. A key's first length tells how many
characters it has, so a candidate ends where its structure does.

Edge cases: null is an empty text; positions are code points; a text is scanned whole, however long; spans are sorted
by start, kind and end; a repeated secret is reported at each place and repeated rows each; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from gridlore.llm.common import byte_chunks

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "token")

_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*): *(.*)")
#: DER begins with 30 and a length, so its base64 begins with M and A to P. What a line break is, real or escaped.
_DER64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=\\r))M[A-P][A-Za-z0-9+/_-]{38,}")
_OPENSSH_MAGIC = b"openssh-key-v1\0"
_SSH64_START = "b3BlbnNzaC1rZXktdjE"
_SSH64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=\\r))b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]+")
_BREAK = re.compile(r"\r?\n|\\r\\n|\\n")
_RUN64 = re.compile(r"[A-Za-z0-9+/_-]+")
_HEXRUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
#: The first base64 character of a brace, or of white space before it, is one of these.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([eICD][A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
#: Octets of a signature by algorithm; of an RSA signature the least.
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0}
_RSA_ALGORITHMS, _RSA_LEAST = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), 128
#: Octets of a block by the cipher that an encrypted PEM block names.
_CIPHER_BLOCK = {"DES": 8, "AES": 16}

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, spans array<struct<kind:string,start:long,end:long,detail:string>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))


def unbase64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def der_size(data: bytes) -> int | None:
    """Octets of the DER sequence that data begins with, by its own length."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    size = data[1]
    if size < 0x80:
        return 2 + size
    n = size & 0x7F
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 and len(data) >= 2 + n else None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill data exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def der_key(data: bytes) -> str | None:
    """The kind of private key that a DER encoding holds; its nested lengths must fit at every level."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != _SEQUENCE:
        return None
    items = der_items(top[0][1])
    if not items:
        return None
    tags = [t for t, _ in items]
    if tags == [_INTEGER] * 9 and items[0][1] == b"\0" or tags == [*[_INTEGER] * 9, _SEQUENCE] and items[0][1] == b"\1":
        return "pkcs1"
    if tags == [_INTEGER] * 6 and items[0][1] == b"\0":
        return "dsa"
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and items[0][1] in (b"\0", b"\1"):
        inner = der_items(items[1][1])
        return "pkcs8" if inner and inner[0][0] == _OID and der_items(items[2][1]) else None
    if tags[:2] == [_INTEGER, _OCTETS] and items[0][1] == b"\1" and len(items[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "sec1"
    if tags == [_SEQUENCE, _OCTETS]:
        inner = der_items(items[0][1])
        return "pkcs8-encrypted" if inner and inner[0][0] == _OID else None
    return None


def openssh_size(data: bytes) -> int | None:
    """Octets of the OpenSSH key file that data begins with, by its length-prefixed fields."""
    if not data.startswith(_OPENSSH_MAGIC):
        return None
    at, left = len(_OPENSSH_MAGIC), 3
    while left:
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        left -= 1
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def openssh_key(data: bytes) -> bool:
    return openssh_size(data) == len(data)


def signed_token(head: str, body: str, signature: str) -> str | None:
    """The algorithm of a signed token whose header, payload and signature length agree."""
    raw, load, sign = unbase64(head, True), unbase64(body, True), unbase64(signature, True)
    if raw is None or load is None or sign is None:
        return None
    try:
        header, claims = json.loads(raw), json.loads(load)
    except (ValueError, RecursionError):
        return None
    algorithm = header.get("alg") if isinstance(header, dict) and isinstance(claims, dict) else None
    if not isinstance(algorithm, str):
        return None
    fits = len(sign) >= _RSA_LEAST if algorithm in _RSA_ALGORITHMS else _SIGNATURE.get(algorithm) == len(sign)
    return algorithm if fits else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def pem_kind(body: str) -> str | None:
    """The kind of key that the lines of a PEM block hold."""
    lines = [x.strip() for x in re.split(r"\r?\n|\\r\\n|\\n|\r", body)]
    headers = {}
    while lines and (not lines[0] or ":" in lines[0]):
        if m := _HEADER.fullmatch(lines.pop(0)):
            headers[m[1]] = m[2]
    data = unbase64("".join("".join(lines).split()))
    if not data:
        return None
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        cipher, _, start = headers.get("DEK-Info", "").partition(",")
        block = _CIPHER_BLOCK.get(cipher[:3])
        whole = block and re.fullmatch(r"[0-9A-Fa-f]*", start) and len(start) == 2 * block and len(data) % block == 0
        return "encrypted-pem" if whole else None
    return der_key(data) or ("openssh" if openssh_key(data) else None)


def lined_base64(text: str, start: int, chars: int | None = None) -> tuple[str, int]:
    """Base64 characters from start on, over line breaks, as many as there are or as wanted; and where they end."""
    parts, at, n = [], start, 0
    while m := _RUN64.match(text, at):
        part = m[0] if chars is None else m[0][: chars - n]
        parts.append(part)
        n += len(part)
        at = m.start() + len(part)
        if n == chars or not (line := _BREAK.match(text, at)) or not _RUN64.match(text, line.end()):
            break
        at = line.end()
    return "".join(parts), at


def either_base64(text: str) -> bytes | None:
    return unbase64(text.replace("-", "+").replace("_", "/"))


def base64_key(text: str, start: int) -> tuple[int, str, str] | None:
    """End, kind and detail of the key whose base64 begins at start."""
    if text.startswith(_SSH64_START, start):
        chars, _ = lined_base64(text, start)
        data = either_base64(chars[: len(chars) // 4 * 4]) if len(chars) % 4 == 1 else either_base64(chars)
        size, kind = data and openssh_size(data), "openssh"
    else:
        head = either_base64(text[start : start + 8])
        size, kind = head and der_size(head), "der"
    if not size:
        return None
    wanted = -(-size * 4 // 3)
    chars, end = lined_base64(text, start, wanted)
    if len(chars) < wanted or _RUN64.match(text, end):
        return None
    data = either_base64(chars)
    detail = data and (der_key(data) if kind == "der" else "openssh" if openssh_key(data) else None)
    if not detail:
        return None
    for _ in range(-wanted % 4):
        end += text.startswith("=", end)
    return end, kind, detail


def confirmed_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Encoded secrets whose structure holds."""
    out: list[tuple[str, int, int, str]] = []
    held: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if kind := pem_kind(m[2]):
                out.append(("pem", *m.span(), kind))
                held.append(m.span())
    for pattern, sign in ((_DER64, "M"), (_SSH64, _SSH64_START)):
        if sign in text:
            for m in pattern.finditer(text):
                if not any(a <= m.start() < b for a, b in held) and (key := base64_key(text, m.start())):
                    out.append((key[1], m.start(), key[0], key[2]))
    for m in _HEXRUN.finditer(text):
        if len(m[0]) % 2:
            continue
        data = bytes.fromhex(m[0])
        if kind := der_key(data):
            out.append(("der", *m.span(), f"{kind}-hex"))
        elif openssh_key(data):
            out.append(("openssh", *m.span(), "openssh-hex"))
        elif data.isascii() and (inner := _TOKEN.match(data.decode())) and inner.end(3) == len(data) and (algorithm := signed_token(*inner.groups())):
            out.append(("token", *m.span(), f"{algorithm}-hex"))
    if "." in text:
        done = 0
        for m in _TOKEN.finditer(text):
            if m.start() >= done and (algorithm := signed_token(*m.groups())):
                done = m.end(3)
                out.append(("token", m.start(), done, algorithm))
    return out


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """All spans (kind, start, end, detail) by start, then kind."""
    found = [(*x, "") for x in base_spans(text)] + confirmed_spans(text)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds and all spans."""

    def work(batches):
        for part, texts in byte_chunks(batches, "text"):
            found = [scan(x.decode()) for x in texts]
            count = lambda kind: pa.array([sum(s[0] == kind for s in x) for x in found], pa.int64())  # noqa: B023, E731
            yield pa.record_batch({
                "doc_id": part.column("doc_id").cast(pa.int64()),
                "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
                "spans": pa.array([[dict(zip(("kind", "start", "end", "detail"), s, strict=True)) for s in x] for x in found], _SPANS),
            })

    return docs.select("doc_id", "text").mapInArrow(work, RESULT)
