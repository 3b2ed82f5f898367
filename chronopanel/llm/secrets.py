"""Secret scans with structural confirmation.

The base patterns report a keyword assignment, an access key id or a run of hex digits as they stand. On top of
them, candidates that could hold a key are decoded (PEM bodies, base64, base64url, hex) and parsed before they are reported:

* ``jwt``: three dot-separated parts whose header is a JSON object with a string ``alg`` and whose payload is a JSON object; the header may be any
  part of a dotted name, or the end of one from ``eyJ`` on;
* ``pem``: a private key block whose body decodes to one of the key encodings below;
* ``key``: base64 or hex that decodes to a DER SEQUENCE whose nested lengths add up exactly and that starts with a
  version INTEGER followed by what a PKCS#1, PKCS#8 or SEC1 private key has there, or to an OpenSSH private key whose
  length-prefixed fields fit. A key may start anywhere in a run of such characters: wherever they spell the beginning of an encoding, as much is
  decoded as its length says, over line ends and escaped line ends if the lines are alike. A ``key`` inside a ``pem`` isn't reported again.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows are scanned one by one, whole however long, with
no shuffle; repeated rows give repeated results. Spans that start at one place are listed by kind. Only doc_id and text are read, so
other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chronopanel.llm.common import batches, rows_of, texts, type_of

WORDS = ("passwd", "password", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HEADER = re.compile(r"[A-Za-z0-9_-]{12,}+\.(?=[A-Za-z0-9_-]{3})")
AFTER_HEADER = re.compile(r"([A-Za-z0-9_-]{3,}+)\.[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]*)-----END \1-----")
#: How a SEQUENCE of any length form with a version INTEGER, or an OpenSSH key, begins in base64 and in hex.
BASE64_START = re.compile(r"M(?=[A-H][AEIMQUYcgkosw048]CAQ|I[E-H][\w+/-]AgE[ABC]|I[I-L][\w+/-]{2}[AQgw]IB)|b(?=3BlbnNzaC1rZXktdjEA)", re.ASCII)
HEX_START = re.compile(r"3(?=0(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4})02010[0-2])|6(?=f70656e7373682d6b65792d763100)", re.ASCII | re.IGNORECASE)
#: What may stand inside an encoding that is wrapped.
WRAP = r"(?:[ \t]*(?:\r?\n|\\r|\\n)[ \t]*)"
BASE64_PART, HEX_PART = (re.compile(rf"[{x}]+|{WRAP}+(?=[{x}])") for x in (r"A-Za-z0-9+/_-", "0-9A-Fa-f"))
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18


def lengths(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at ``at``, if its length field fits before ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + size]), at + size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def members(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while start < end:
        if (one := lengths(data, start, end)) is None:
            return None
        found.append(one)
        start = one[2]
    return found


INTEGER, OCTETS, SEQUENCE = 0x02, 0x04, 0x30


def is_der_key(data: bytes) -> bool:
    outer = lengths(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] != len(data):
        return False
    parts = members(data, outer[1], outer[2])
    if not parts or parts[0][0] != INTEGER or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 2:
        return False
    tags = [p[0] for p in parts]
    if len(tags) >= 9 and tags[:9] == [INTEGER] * 9:
        return True  # PKCS#1
    if tags[1:3] == [SEQUENCE, OCTETS] and members(data, parts[1][1], parts[1][2]) is not None:
        return True  # PKCS#8
    return tags[1:2] == [OCTETS] and parts[1][2] - parts[1][1] >= 16 and data[parts[0][1]] == 1 and all(t & 0xA0 == 0xA0 for t in tags[2:])  # SEC1


OPENSSH = b"openssh-key-v1\0"


def is_openssh_key(data: bytes) -> bool:
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4])) > len(data):
            return False
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4]) <= 64


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def holds_object(part: str, *keys: str) -> bool:
    try:
        value = json.loads(decoded(part, True) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and all(isinstance(value.get(k), str) for k in keys)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower() if text.isascii() else text.translate(ASCII_LOWER)
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def unwrapped(text: str, at: int, part: re.Pattern, most: int) -> tuple[str, list[int]]:
    """Up to ``most`` characters of an encoding from ``at`` on, without what wraps it, and the place of each."""
    kept, places = [], []
    while len(places) < most and (m := part.match(text, at)):
        at = m.end()
        if not m[0][0].isspace() and m[0][0] != "\\":
            here = m[0][: most - len(places)]
            kept.append(here)
            places.extend(range(m.start(), m.start() + len(here)))
    return "".join(kept), places


MOST_LINE = 128


def in_lines(text: str, places: list[int], part: re.Pattern) -> bool:
    """Whether an encoding that goes over line ends looks wrapped: lines of one length, none long, the last one ended by something else."""
    breaks = [i for i, (a, b) in enumerate(zip(places, places[1:], strict=False), 1) if b != a + 1]
    if not breaks:
        return True
    sizes = [b - a for a, b in zip([0, *breaks], [*breaks, len(places)], strict=True)]
    after = text[places[-1] + 1 : places[-1] + 2]
    return max(sizes) <= MOST_LINE and len(set(sizes[1:-1])) < 2 and max(sizes[0], *sizes[1:-1], 0) >= sizes[-1] and not (after and after != "\\" and part.match(after))


def openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH key at the start of ``data`` so far as its fields say; one more than there are if they go on."""
    at = len(OPENSSH)
    for step in range(3 + 2):
        if step == 3:
            at += 4
            count = int.from_bytes(data[at - 4 : at])
        for _ in range(1 if step != 3 else min(count, 64)):
            if at + 4 > len(data):
                return len(data) + 1
            at += 4 + int.from_bytes(data[at : at + 4])
    return at


MOST_KEY = 1 << 16


def key_at(text: str, at: int, part: re.Pattern, hexes: bool) -> int | None:
    """The end of the key that starts at ``at``, or None if what stands there isn't one."""

    def bytes_of(n: int) -> tuple[bytes, list[int]]:
        found, places = unwrapped(text, at, part, 2 * n if hexes else -(-n * 4 // 3))
        if hexes:
            return bytes.fromhex(found[: len(found) // 2 * 2]), places
        return decoded(found[: len(found) if len(found) % 4 != 1 else -1].replace("-", "+").replace("_", "/")) or b"", places

    head, _ = bytes_of(24)
    if head.startswith(OPENSSH):
        size = openssh_size(bytes_of(MOST_KEY)[0])
    elif len(head) > 4 and head[0] == SEQUENCE:
        size = 2 + head[1] if head[1] < 0x80 else 2 + (head[1] & 0x7F) + int.from_bytes(head[2 : 2 + (head[1] & 0x7F)])
    else:
        return None
    if size > MOST_KEY:
        return None
    data, places = bytes_of(size)
    if len(data) < size or not is_key(data[:size]) or not in_lines(text, places, part):
        return None
    end = places[-1] + 1
    while not hexes and -size % 3 and end < len(text) and text[end] == "=" and end - places[-1] <= -size % 3:
        end += 1
    return end


def token_spans(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for m in HEADER.finditer(text):
        rest = AFTER_HEADER.match(text, m.end())
        if m.start() < done or not rest:
            continue
        name = m[0][:-1]
        for at in [0, *(k.start() for k in re.finditer("eyJ", name) if k.start())]:
            if len(name) - at >= 12 and holds_object(name[at:], "alg") and holds_object(rest[1]):
                done = rest.end()
                yield m.start() + at, done, "jwt"
                break


def key_spans(text: str, blocks: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    for start, part, hexes in ((BASE64_START, BASE64_PART, False), (HEX_START, HEX_PART, True)):
        done = 0
        for m in start.finditer(text):
            if m.start() >= done and not any(a <= m.start() < b for a, b, _ in blocks) and (end := key_at(text, m.start(), part, hexes)):
                done = end
                yield m.start(), end, "key"


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    blocks = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = decoded(re.sub(r"\\[nr]|\s", "", m[2]))
            if data and is_key(data):
                blocks.append((m.start(), m.end(), "pem"))
    return [*token_spans(text), *key_spans(text, blocks), *blocks]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_confirmed, base_sha256 (of the base spans' list), spans (all)."""
    ddl = f"doc_id {type_of(docs, 'doc_id')}, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_sha256 string, spans string"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in it:
                for doc_id, text in rows_of(batch, "doc_id", "text"):
                    base, more = base_spans(text), confirmed_spans(text)
                    kinds = [s[2] for s in base]
                    yield (doc_id, *map(kinds.count, KINDS[:3]), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more))

        yield from batches(rows(), ddl)

    return texts(docs, "doc_id").mapInArrow(each, ddl)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every reported span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(base_spans(text) + confirmed_spans(text)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced and ``n_chars``, where there is one, counted anew; null texts stay null."""
    at, schema = docs.columns.index("text"), docs.schema

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fixed = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(fixed, batch.schema.field(at).type)
            if "n_chars" in docs_columns:
                k = docs_columns.index("n_chars")
                columns[k] = pa.array([old if t is None else len(t) for t, old in zip(fixed, batch.column(k).to_pylist(), strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    docs_columns = list(docs.columns)
    return docs.mapInArrow(each, schema)
