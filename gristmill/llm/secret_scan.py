"""Secret scans: keyword automaton, anchored expressions near its hits, checksums.

An Aho-Corasick automaton over the lower-cased UTF-8 bytes of a text finds
every keyword in one pass. Regular expressions are only ever tried anchored at
such a hit; texts without hits cost no regular expression. Long runs of
hexadecimal digits, which no keyword announces, are found by a byte search.
Formats that carry a checksum or a checkable structure are taken if it holds:

    github, npm   prefix and 36 characters, the last six the CRC-32 of the others in base 62
    jwt           three base64url parts, the first (of 11 to 8,192 characters) a JSON object that names `alg`
    pem           a private-key block whose base64 is one DER sequence of the length it says

Spans are half-open and count code points. Null texts count as empty and have
none; ties and repeated rows are scanned each; an empty table gives no rows;
very long texts are scanned whole, in time in proportion to their length. Other
columns pass through; one named like an added column (`secrets`) is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import add_columns, per_slice, texts

#: The kinds in their order, the keywords and the formats.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
URL64 = re.compile(r"[A-Za-z0-9_-]+")
JWT_REST = re.compile(r"\.(eyJ[A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})")
#: Characters of a header at most, and 11 at least: what is longer is no token.
HEADER = 8192
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_AS_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for kind, words in {"assign": ASSIGN_WORDS, "access": ("akia",), "checked": (*GITHUB_PREFIXES, "npm_"), "jwt": ("eyj",), "pem": ("-----begin ",)}.items():
            for word in words:
                _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def base62(n: int) -> str:
    out = ""
    while n or len(out) < 6:
        n, k = divmod(n, 62)
        out = DIGITS62[k] + out
    return out


def _header(part: str) -> bool:
    """Whether a base64url part is a JSON object that names `alg`. Its end is looked at first, so that most others cost little."""
    pad = "=" * (-len(part) % 4)
    try:
        if len(part) > HEADER or base64.urlsafe_b64decode(part[-4 - len(part) % 4 :] + pad).rstrip()[-1:] != b"}":
            return False
        return "alg" in json.loads(base64.urlsafe_b64decode(part + pad))
    except (ValueError, TypeError, RecursionError):
        return False


def _der(m: re.Match) -> bool:
    try:
        raw = base64.b64decode("".join(m[2].split()), validate=True)
    except binascii.Error:
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    size = raw[1] & 0x7F
    return len(raw) == (2 + raw[1] if raw[1] < 128 else 2 + size + int.from_bytes(raw[2 : 2 + size], "big"))


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted by start, then by kind as listed."""
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, str]] = []
    ends = dict.fromkeys(("assign", "access", "checked", "jwt", "pem"), 0)
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in automaton().iter(raw.lower().decode("latin-1")))
    byte = point = run = 0
    rest = None  # what follows the run of base64url characters that ends at `run`, if it can follow a header
    for start, kind in hits:
        if len(raw) == len(text):
            at = start
        else:
            point += len(raw[byte:start].decode("utf-8", "surrogatepass"))
            byte, at = start, point
        if at < ends[kind]:
            continue
        if kind == "assign" and (m := ASSIGN.match(text, at)):
            ends[kind] = m.end()
            if len(m[1]) >= 6:
                found.append((at, m.end(), kind))
        elif kind == "access" and (m := ACCESS.match(text, at)):
            ends[kind] = m.end()
            if m.end() - at >= 20:
                found.append((at, m.end(), kind))
        elif kind == "checked" and (m := CHECKED.match(text, at)) and base62(zlib.crc32(m[1].encode())) == m[2]:
            ends[kind] = m.end()
            found.append((at, m.end(), "npm" if text.startswith("npm", at) else "github"))
        elif kind == "jwt" and text.startswith("eyJ", at):
            if at >= run:  # a run is read once, however many hits it holds
                run = URL64.match(text, at).end()
                rest = JWT_REST.match(text, run)
            if rest and run - at >= 11 and _header(text[at:run] if run - at <= HEADER else text[run - HEADER - 1 : run]):
                ends[kind] = rest.end()
                found.append((at, rest.end(), kind))
        elif kind == "pem" and (m := PEM.match(text, at)) and _der(m):
            ends[kind] = m.end()
            found.append((at, m.end(), kind))
    if raw.translate(_AS_HEX).find(b"h" * 24) >= 0:
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def secret_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with `secrets`: the spans found in each whole text."""

    def fn(part: pa.RecordBatch) -> dict:
        return {"secrets": [[{"start": a, "end": b, "kind": k} for a, b, k in scan(x)] for x in texts(part.column(text))]}

    return add_columns(docs, fn, f"secrets {SPANS}", text, keep)


def redact(text: str) -> str:
    """The text with each stretch of overlapping secrets replaced by the kind of its first."""
    out, at = [], 0
    for a, b, kind in scan(text):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with secrets replaced in `text`, and the new length in code points in the column `length`, if it has one. Null stays null."""
    length = length if length in docs.columns else None

    def fn(part: pa.RecordBatch) -> dict:
        new = [None if x is None else redact(x) for x in part.column(text).to_pylist()]
        return {text: new} | ({length: [None if x is None else len(x) for x in new]} if length else {})

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(part)
        return pa.RecordBatch.from_arrays([pa.array(made[c], part.schema.field(c).type) if c in made else part.column(c) for c in part.schema.names], names=part.schema.names)

    return docs.mapInArrow(per_slice(run, text), docs.schema)
