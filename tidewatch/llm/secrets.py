"""Secret scans: pattern matches, and encoded keys and tokens confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import map_batches

#: Kinds in the order that ties at one start are listed in; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: A block's type, its header lines and its body; line ends are real ones or escapes as in JSON and source strings.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?:(?:\\+[nr]|[\r\n])[ \t]*)+[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*)*)([A-Za-z0-9+/=\s\\]+)-----END \1-----")
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED.*DEK-Info:\s*[A-Za-z0-9-]+,\s*(?:[0-9A-Fa-f]{16}){1,2}(?![0-9A-Fa-f])", re.S)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Base64 over lines, without a frame.
_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}(?:\\+[nr]|[\r\n])+)+[A-Za-z0-9+/]+={0,2}")
#: Names that open a key in the SSH wire format, the fields of the public key (a private one has more), and the magic of private key files.
_SSH = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
_SSH_FILE = b"openssh-key-v1\0"


def _base64(text: str) -> bytes | None:
    text = re.sub(r"\\+(?:u003[Dd]|[nrt])|[\s\\=]", "", text).replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, int, list]] | None:
    """(tag, length, elements inside) of every element, or None where a length doesn't fit exactly."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n, i = data[i], data[i + 1], i + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data) or data[i] == 0:
                return None
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
            if n < 0x80:
                return None
        if i + n > len(data):
            return None
        inner: list | None = []
        if tag & 0x20:
            inner = der_items(data[i : i + n], depth + 1) if depth < 16 else None
            if inner is None:
                return None
        out.append((tag, n, inner))
        i += n
    return out


def _is_private_der(data: bytes) -> bool:
    """One sequence: a version and then an octet string (SEC 1), an algorithm and an octet string (PKCS 8) or five and more
    integers (PKCS 1, DSA); or an algorithm and an octet string (encrypted PKCS 8). Public keys and certificates have none of these."""
    items = der_items(data)
    if not items or len(items) != 1 or items[0][0] != 0x30:
        return False
    inner = items[0][2]
    tags = [t for t, _, _ in inner]
    if tags[:1] == [2] and inner[0][1] == 1:
        rest = inner[1:]
        if tags[1:2] == [4]:
            return rest[0][1] >= 16
        if tags[1:3] == [0x30, 4]:
            return rest[0][2][:1] != [] and rest[0][2][0][0] == 6 and rest[1][1] >= 16
        return len(rest) >= 5 and all(t == 2 for t in tags[1:6]) and max(n for _, n, _ in rest) >= 16
    return tags == [0x30, 4] and inner[0][2][:1] != [] and inner[0][2][0][0] == 6 and inner[1][1] >= 16


def _is_ssh_file(data: bytes) -> bool:
    """Cipher, key derivation, its options, a number of keys, so many public keys and the private part, to the last byte."""
    at = len(_SSH_FILE)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, derivation, options = field(), field(), field()
    keys = int.from_bytes(data[at : at + 4], "big")
    if not cipher or not derivation or options is None or not 1 <= keys <= len(data) // 24:
        return False
    at += 4
    if not all(_ssh_fields(field() or b"") for _ in range(keys)):
        return False
    return bool(field()) and at == len(data)


def _is_pem(headers: str, body: str) -> bool:
    """A body that decodes to a key; an encrypted one, as its headers say, to whole blocks of a cipher."""
    data = _base64(body)
    if _ENCRYPTED.search(headers):
        return data is not None and len(data) >= 24 and len(data) % 8 == 0
    return is_key(data)


def is_key(data: bytes | None) -> bool:
    """A private key: DER with all nested lengths right, an SSH key file, or SSH fields beyond those of the public key."""
    if not data or len(data) < 24:
        return False
    if data.startswith(_SSH_FILE):
        return _is_ssh_file(data)
    if data[:1] == b"\x30":
        return _is_private_der(data)
    return _ssh_fields(data) > _SSH.get(data[4 : 4 + int.from_bytes(data[:4], "big")], 99)


def _ssh_fields(data: bytes) -> int:
    """Length-prefixed fields of an SSH key, its name among them; 0 if lengths don't fit exactly, or too few."""
    name, i, fields = data[4 : 4 + int.from_bytes(data[:4], "big")], 0, 0
    if name not in _SSH:
        return 0
    while i + 4 <= len(data):
        i += 4 + int.from_bytes(data[i : i + 4], "big")
        fields += 1
    return fields if i == len(data) and fields >= _SSH[name] else 0


def is_signed_token(text: str) -> bool:
    """Its first part decodes to a JSON object that names an algorithm, its second to a JSON object."""
    head, body = (_base64(x) for x in text.split(".")[:2])
    try:
        head, body = json.loads(head or b""), json.loads(body or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    out += [("pem", *m.span()) for m in _PEM.finditer(text) if _is_pem(m[2], m[3])]
    framed = [(a, b) for kind, a, b in out if kind == "pem"]
    wrapped = [m.span() for m in _LINES.finditer(text) if is_key(_base64(m[0]))]
    out += [("key", a, b) for a, b in wrapped if not any(x <= a and b <= y for x, y in framed)]
    for m in _RUN.finditer(text):
        plain = m[0].rstrip("=")
        if is_key(_base64(plain)) or (len(plain) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", plain) and is_key(bytes.fromhex(plain))):
            out.append(("key", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """text with the union of the sorted spans replaced by mark; spans that overlap have one mark."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _scan(text_at: int, mark: str | None):
    def run(batches):
        for batch in batches:
            spans, clean = [], []
            for t in batch.column(text_at):
                text = t.as_py()
                found = find_secrets(text or "")
                spans.append([dict(zip(("kind", "start", "end"), x)) for x in found])
                clean.append(redacted(text, found, mark) if found and mark is not None else text)
            more = [] if mark is None else [pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPANS), *more], [*batch.schema.names, "spans", *["redacted"] * len(more)])

    return run


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, mark: str | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None; text_col always among them) and
    spans array<struct<kind, start, end>> of the secrets in each whole text; with a ``mark``, also redacted, the text with the mark
    in place of each secret (overlapping ones share one).

    Base kinds: assign (a name of a secret, : or =, and a value of 6 characters or more),
    access (AKIA..., 20 or more), hex (24 or more lower-case digits). Confirmed kinds: jwt (its
    header is JSON with an algorithm), pem (a private key block whose body decodes to a key, or whose headers say that it is
    encrypted and whose body decodes to whole cipher blocks; line ends may be escaped), key
    (a base64 or hex run of 40 or more characters, or base64 over lines, that decodes to a private key: DER with exact
    nested lengths, an SSH key file or SSH fields). Public keys and certificates aren't reported. Spans of different kinds may overlap.

    Rows are scanned where they lie, without a shuffle, in time linear in a text's length. Null and empty texts have no spans and
    are redacted to themselves; repeated rows are scanned each; columns named spans or redacted in docs are replaced; an empty table
    gives no rows.
    """
    cols = [c for c in (keep if keep is not None else docs.columns) if c not in ("spans", "redacted")]
    rows = docs.select(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    more = "" if mark is None else ", redacted string"
    return map_batches(rows, _scan(cols.index(text_col), mark), f"{schema}, spans array<struct<kind: string, start: long, end: long>>{more}")
