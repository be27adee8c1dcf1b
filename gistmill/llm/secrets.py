"""Secret scanning with structural confirmation of encoded keys.

Base kinds are patterns, leftmost and non-overlapping per kind, whose matches that are
too short are dropped:

* ``assign``: a keyword (ASCII letters in either case), ``:`` or ``=``, and a value of 6 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters in all;
* ``hex``: 24 or more lower-case hexadecimal digits.

Confirmed kinds are reported only if what they encode parses:

* ``jwt``: three base64url parts joined by dots, of which the last may be empty; the first two decode to JSON
  objects, however spaced, and the first names an ``alg``;
* ``pem``: a private-key block whose body is base64 of a confirmed key (or, for encrypted
  legacy blocks, follows ``Proc-Type``);
* ``der``: base64 or hex (of either case) outside such blocks that decodes to an ASN.1 SEQUENCE whose
  nested lengths fit exactly and which has the shape of a private key: PKCS#1 (version
  and eight integers), PKCS#8 (version, algorithm with an object identifier, octets) or
  SEC1 (version 1, octets);
* ``ssh``: base64 of an OpenSSH private key (``openssh-key-v1`` and its length-prefixed
  fields).

Line ends may be escaped as in JSON.  A key is looked for from every place of a run of base64 where
one may start, so it may be glued to other characters.  A run that encodes a text with one of these kinds (a
whole PEM file, say) is reported whole, as the first of them; one level is opened.

Spans are code-point offsets into the whole text, end exclusive.

Defined cases.  A null text is read as empty: no spans, and the checksum of the empty
string.  Repeated rows give repeated results.  Texts are scanned whole, row by row,
nothing is shuffled.  Other columns are ignored, whatever their names.  Empty tables
give empty results.
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
from pyspark.sql import functions as F

from gistmill.llm.common import documents, id_and_text, small_batches

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
#: Three parts, of which the first may be glued to what stands before it; its characters that a brace or white space may start with.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{11,}+)(?=\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+))")
_JWT_START = re.compile(r"[CDIe](?=[A-Za-z0-9_-]{10})")
_JSON, _JSON_SPACE = json.JSONDecoder(), re.compile(r"[\x20\t\r\n]*")
#: A line end, also one escaped once or more as in JSON, and the next line's indentation.
_BREAK = r"(?:\r?\n|\\+(?:[nrt]|u000[aAdD]))+[\x20\t]*"
_BREAKS = re.compile(_BREAK)
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:(?!-----)(?:[A-Za-z0-9+/=\s:,-]|\\+(?:[nrt/\s]|u000[aAdD])))*)-----END \1PRIVATE KEY-----")
_ESCAPES = re.compile(r"\\+(?:[nrt\s]|u000[aAdD])")
#: Base64 of 40 or more characters, also over lines of it; hexadecimal of 64 or more.
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{40,}}(?:{_BREAK}[A-Za-z0-9+/_-]{{4,}})*={{0,2}}")
#: Where a SEQUENCE, "openssh-key-v1" or "-----B" may start in a run of base64.
_STARTS = re.compile(r"M|b3BlbnNza|LS0tLS1C")
_HEX_DER = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?(30(?:[0-9a-f]{2}){31,}|30(?:[0-9A-F]{2}){31,})(?![0-9A-Za-z])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    at = 0
    while hit := _LONG_HEX.search(text, at):  # the first 24 digits of a run start it: a run has no earlier start
        at = _HEX.match(text, hit.start()).end()
        found.append((hit.start(), at, "hex"))
    return found


def unbase64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64 with or without padding, None if it isn't."""
    body = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of each element that together fill data[start:end] exactly, else None."""
    items = []
    at = start
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def der_size(head: bytes) -> int:
    """The bytes of a SEQUENCE that starts with ``head`` and a version of 0 or 1; 0 if it does not."""
    if len(head) < 9 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80 or head[2 + n : 4 + n] != b"\x02\x01" or head[4 + n : 5 + n] > b"\x01":
        return 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is one SEQUENCE shaped like a PKCS#1, PKCS#8 or SEC1 private key."""
    top = der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der(data, *top[0][1:])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    version, tags = data[inner[0][1]], [x[0] for x in inner]
    if tags[:9] == [0x02] * 9 and version <= 1:
        return True
    if version <= 1 and tags[1:3] == [0x30, 0x04]:
        algorithm = der(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return version == 1 and len(tags) > 1 and tags[1] == 0x04 and inner[1][2] - inner[1][1] >= 16


def ssh_size(data: bytes) -> int:
    """The bytes of the OpenSSH private key that ``data`` starts with: magic, three length-prefixed names, a count and that many public keys; else 0."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at = len(magic)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return 0
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= count <= 16 and all(field() for _ in range(count + 1)) else 0


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is one OpenSSH private key."""
    return bool(data) and ssh_size(data) == len(data)


def _whole(flat: str) -> bytes:
    """The whole bytes of base64 without padding, of any length."""
    return unbase64(flat[: len(flat) - (len(flat) % 4 == 1)]) or b""


def _run_spans(run: str, nested: int) -> list[tuple[int, int, str]]:
    """Keys in one run of base64, from wherever in it one may start; and, one level down, in the text that it encodes."""
    flat, breaks = _BREAKS.sub("", run).rstrip("="), [m.span() for m in _BREAKS.finditer(run)]

    def place(i: int) -> int:
        for a, b in breaks:
            if a > i:
                break
            i += b - a
        return i

    found, at = [], 0

    def add(start: int, end: int, kind: str) -> None:
        nonlocal at
        last = place(end - 1) + 1
        while end == len(flat) and last < len(run) and run[last] == "=":
            last += 1
        found.append((place(start), last, kind))
        at = end

    if nested and (data := _whole(flat)) and confirmed_spans(data.decode("latin-1"), 0):
        kind = confirmed_spans(data.decode("latin-1"), 0)[0][2]
        add(0, len(flat), kind)
    while hit := _STARTS.search(flat, at):
        start = hit.start()
        at = start + 1
        if hit[0] == "M":
            size = der_size(_whole(flat[start : start + 16]))
            end = start + -(-size * 4 // 3)
            if size and end <= len(flat) and is_der_key((unbase64(flat[start:end] + "A" * (-(end - start) % 4)) or b"")[:size]):
                add(start, end, "der")
        elif hit[0][0] == "b":
            rest = flat[start:]
            if size := ssh_size(unbase64(rest + "A" * (-len(rest) % 4)) or b""):
                end = start + -(-size * 4 // 3)
                if end <= len(flat):
                    add(start, end, "ssh")
        elif nested and start and confirmed_spans(_whole(flat[start:]).decode("latin-1"), 0):
            add(start, len(flat), "pem")
    return found


def _object(raw: bytes | None) -> dict | None:
    try:
        value = json.loads(raw) if raw and raw.lstrip()[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _token_start(run: str) -> int:
    """The first place in a run of base64url from which it decodes to an object that names an ``alg``; -1 if there is none.

    The run is decoded once for each of the four places at which a group may start, and parsed from each brace only as far as it is JSON.
    """
    views: dict[int, tuple[bytes, str]] = {}
    for start in _JWT_START.finditer(run):
        at = start.start()
        if at % 4 not in views:
            raw = unbase64(run[at % 4 :]) or b""
            views[at % 4] = raw, raw.decode("latin-1")
        raw, text = views[at % 4]
        place = at // 4 * 3
        brace = _JSON_SPACE.match(text, place).end()
        if text[brace : brace + 1] != "{":
            continue
        try:
            end = _JSON.raw_decode(text, brace)[1]
        except (ValueError, RecursionError):
            continue
        if _JSON_SPACE.fullmatch(text, end) and (head := _object(raw[place:])) and isinstance(head.get("alg"), str):
            return at
    return -1


def confirmed_spans(text: str, nested: int = 1) -> list[tuple[int, int, str]]:
    found = []
    for m in _JWT.finditer(text):
        if _object(unbase64(m[2])) is not None and (at := _token_start(m[1])) >= 0:
            found.append((m.start() + at, m.end(3), "jwt"))
    taken: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = unbase64(_ESCAPES.sub("\n", m[2]).replace("\\", "")) if "Proc-Type" not in m[2] else None
            if "Proc-Type" in m[2] or (data and (is_der_key(data) or is_ssh_key(data) or (m[1] == "ENCRYPTED " and der(data, 0, len(data)) is not None))):
                found.append((m.start(), m.end(), "pem"))
                taken.append(m.span())
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in taken)
    for m in _BASE64.finditer(text):
        if free(m):
            found += [(m.start() + a, m.start() + b, kind) for a, b, kind in _run_spans(m[0], nested)]
    if "30" in text:
        for m in _HEX_DER.finditer(text):
            if free(m) and is_der_key(bytes.fromhex(m[1])):
                found.append((m.start(), m.end(), "der"))
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """gm_id, counts of the base kinds, base_sha256, spans, and (``with_text``) redacted: the text with every span replaced."""
    small_batches(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)
    names = ["gm_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = confirmed_spans(text)
                kinds = [s[2] for s in base]
                out.append((
                    kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                    hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), redact(text, base + more) if with_text else None,
                ))
            columns = list(zip(*out)) or [()] * 6
            kinds_of = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds_of)]], names=names)

    kind = rows.schema["gm_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"gm_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each run of overlapping spans replaced by ``[SECRET]``."""
    parts, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            parts += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redacted(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``df``, with every secret in ``text_col`` replaced, and ``length_col``, if there, brought up to date."""
    small_batches(df.sparkSession)
    place = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(place):
                text = value.as_py()
                spans = base_spans(text) + confirmed_spans(text) if text else []
                out.append(redact(text, spans) if spans else text)
            columns = list(batch.columns)
            columns[place] = pa.array(out, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    clean = df.mapInArrow(work, df.schema)
    if length_col and length_col in df.columns:
        length = F.length(F.col(f"`{text_col}`")).cast(df.schema[length_col].dataType)
        clean = clean.withColumn(length_col, F.when(F.col(f"`{length_col}`").isNotNull(), length))
    return clean


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: pattern spans, and spans confirmed by what they encode."""
    found = scan(documents(spark, sf_dir))
    return found.select(F.col("gm_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
