"""Secret scans: keyword prefilter, anchored patterns near hits, checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over the
text (ASCII letters lowered, so positions stay code points).  Only at a hit is the
kind's regular expression matched, anchored at that position, left to right, so a
match that starts inside an earlier one of its kind is skipped.  ``hex`` has no
keyword: any run of 32 hex characters covers an aligned block of 16, so a byte test
of the blocks is its prefilter.  Formats that embed a checksum or structure are
validated before they count:

* assign  keyword, separator, value of 8 or more characters
* access  AKIA key of 16 or more characters
* hex     32 or more hex digits
* github  ghp_/gho_/ghu_/ghs_/ghr_ + 30 characters + 6 base-62 digits of their CRC-32
* npm     npm_ + 30 characters + 6 base-62 digits of their CRC-32
* jwt     three base64url parts whose header decodes to a JSON object with "alg"
* pem     private key block header to its footer (or to the text's end)

Spans are code points, end exclusive.  Edge cases: null and empty texts have no
spans; each row is judged alone, so repeated rows give repeated results; extra
columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import lru_cache
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orderlab.llm.common import byte_table, rows, steps

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
LOWER = byte_table(True, ())
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
BLOCK = 16  # a run of 32 covers one aligned block of 16

# Keywords (lower case) and patterns of each kind.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin",),
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----END )[\s\S])*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
}
TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]*")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                 ("base_sha256", pa.string()), ("spans", pa.string()),
                 ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
OUT_DDL = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
           "found array<struct<kind:string,start:bigint,end:bigint>>")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    return auto


def crc_digits(body: str) -> str:
    n, out = crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _json_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested too deeply for one
        return False
    return isinstance(head, dict) and "alg" in head


def valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind in ("access", "hex"):
        return len(m[0]) >= (16 if kind == "access" else 32)
    if kind in ("github", "npm"):
        return crc_digits(m[1]) == m[2]
    return _json_header(m[1]) if kind == "jwt" else True


def find(text: str, hex_likely: bool = True) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed."""
    low = text.encode().translate(LOWER).decode()
    past = dict.fromkeys(KINDS, 0)
    out = []
    for at, (kind, size) in automaton().iter(low):
        start = at + 1 - size
        if start < past[kind]:
            continue
        m = PATTERNS[kind].match(text, start)
        if kind == "jwt" and not m:  # no later start in the same run can match
            past[kind] = TOKEN_RUN.match(text, start).end()
        if m:
            past[kind] = m.end()
            if valid(kind, m):
                out.append((kind, start, m.end()))
    if hex_likely:
        out += [("hex", m.start(), m.end()) for m in PATTERNS["hex"].finditer(text) if valid("hex", m)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(column: pa.Array) -> list[list[tuple[str, int, int]]]:
    """Spans of each row of a text column (null: none)."""
    col = pc.fill_null(column.cast(pa.large_binary()), b"")
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(buf[2], np.uint8)[off[0]:off[-1]] if buf[2] is not None else np.zeros(0, np.uint8)
    whole = HEX[raw[:len(raw) // BLOCK * BLOCK]].reshape(-1, BLOCK).all(axis=1)
    at = np.flatnonzero(whole) * BLOCK
    likely = np.zeros(len(col), bool)
    likely[np.searchsorted(off[1:] - off[0], at, side="right")] = True
    return [find(t, h) if t else [] for t, h in zip(column.to_pylist(), likely.tolist(), strict=True)]


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and digest, and all spans (as text and as an array)."""
    def run(batches):
        for batch in steps(batches):
            found = scan(batch.column("text"))
            base = [[s for s in f if s[0] in BASE] for f in found]
            counts = [[sum(s[0] == k for s in b) for b in base] for k in BASE]
            yield rows(OUT, batch.column("doc_id").cast(pa.int64()), *counts,
                       [hashlib.sha256(_join(b).encode()).hexdigest() for b in base], [_join(f) for f in found],
                       [[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found])

    return docs.select("doc_id", "text").mapInArrow(run, OUT_DDL)


def mask(text: str, spans: list[tuple[str, int, int]], label: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``label``."""
    out, pos = [], 0
    for _, a, b in spans:
        if a >= pos:
            out += [text[pos:a], label]
        pos = max(pos, b)
    return "".join(out) + text[pos:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Every document with its secrets masked; ``n_chars``, if present, follows."""
    schema: T.StructType = docs.schema

    def run(batches):
        for batch in steps(batches):
            found = scan(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for i, f in enumerate(found):
                if f:
                    texts[i] = mask(texts[i], f)
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                n = batch.column(at).to_pylist()
                n = [len(t) if f else c for t, f, c in zip(texts, found, n, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(n, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, schema)
