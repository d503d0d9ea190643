r"""Secret scan: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick pass over the ASCII-lowered text finds keyword hits; only there is the rule of that keyword matched,
anchored at the hit.  Runs of hexadecimal digits have no keyword: every eighth byte is looked up in a class table, and the
anchored rule runs only where three such bytes in a row are digits, as any run of 24 contains.  Kinds that embed a check
value must pass it.  Texts are scanned as UTF-8; offsets are given in code points.

Base kinds: assign, access, hex.  Kinds added by the method: ``github`` and ``npm`` (CRC-32 in base 62), ``jwt`` (header and
claims decode as JSON, with an algorithm), ``pypi`` (macaroon header), ``stripe``, ``slack``, ``google``, ``pem``.

Each rule reads a sign a bounded number of times, whatever the text.

Edge cases: spans at one start are ordered by kind, then end; a null or empty text has no spans and the digest of the empty string; repeated rows are scanned alike; other
columns are ignored by ``scan`` and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, map_rows, read_table, utf8

KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pypi", "stripe", "slack", "google", "pem"]
BASE = KINDS[:3]
_RANK = {k: i for i, k in enumerate(KINDS)}
_B62 = {c: i for i, c in enumerate(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}


def _crc62(token: bytes) -> bool:
    """The last six characters are the CRC-32 of the random part in base 62."""
    value = 0
    for c in token[-6:]:
        value = 62 * value + _B62[c]
    return value == zlib.crc32(token.rpartition(b"_")[2][:-6])


def _jwt(token: bytes) -> bool:
    try:
        head, claims = (json.loads(base64.urlsafe_b64decode(p + b"=" * (-len(p) % 4))) for p in token.split(b".")[:2])
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and "alg" in head


def _pypi(token: bytes) -> bool:
    try:
        raw = base64.urlsafe_b64decode(token[5:] + b"=" * (-len(token[5:]) % 4))
    except (ValueError, binascii.Error):
        return False
    return raw[:2] == b"\x02\x01" and b"pypi.org" in raw[:16]


#: kind, keywords in lower case, expression anchored at the keyword, check of the match.
RULES = [
    ("assign", [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"], re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 6),
    ("access", [b"akia"], re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("github", [b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"], re.compile(rb"gh[oprsu]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: _crc62(m[0])),
    ("npm", [b"npm_"], re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc62(m[0])),
    ("jwt", [b"eyj"], re.compile(rb"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), lambda m: _jwt(m[0])),
    ("pypi", [b"pypi-"], re.compile(rb"pypi-[A-Za-z0-9_-]{50,}"), lambda m: _pypi(m[0])),
    ("stripe", [b"sk_live_", b"rk_live_"], re.compile(rb"[sr]k_live_[A-Za-z0-9]{24,}"), lambda m: True),
    ("slack", [b"xoxb-", b"xoxp-", b"xoxa-", b"xoxr-", b"xoxs-"], re.compile(rb"xox[baprs]-[0-9]{8,}-[A-Za-z0-9-]{16,}"), lambda m: True),
    ("google", [b"aiza"], re.compile(rb"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), lambda m: True),
    ("pem", [b"-----begin "], re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"), lambda m: True),
]
#: Of kinds whose match begins with a run that may hold their keyword again: where it fails, it fails for all keywords of the run.
_RUN = {"jwt": re.compile(rb"[A-Za-z0-9_-]++")}
_HEX = re.compile(rb"[0-9a-f]+")
_HEX_CLASS = np.zeros(256, bool)
_HEX_CLASS[list(b"0123456789abcdef")] = True
_HEX_MIN = 24
_AUTOMATON: list = []


def automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for rule, (_, words, _, _) in enumerate(RULES):
            for w in words:
                a.add_word(w.decode("latin-1"), (len(w), rule))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def _hex_runs(data: bytes):
    """The maximal runs of at least 24 hexadecimal digits, as (start, end)."""
    if len(data) < _HEX_MIN:
        return
    step = _HEX_MIN // 3
    hit = _HEX_CLASS[np.frombuffer(data, np.uint8)[::step]]
    end = 0
    for i in np.flatnonzero(hit[:-1] & hit[1:]) if len(hit) < 3 else np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:]):
        at = int(i) * step
        if at < end:
            continue
        while at > end and _HEX_CLASS[data[at - 1]]:
            at -= 1
        m = _HEX.match(data, at)
        end = m.end()
        if end - at >= _HEX_MIN:
            yield at, end


def spans(data: bytes | None) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, value start) in bytes, by start, then kind."""
    data = data or b""
    found = []
    ends = [0] * len(RULES)
    hits = [(end + 1 - n, rule) for end, (n, rule) in automaton().iter(data.lower().decode("latin-1"))]
    for at, rule in sorted(hits):
        if at < ends[rule]:
            continue
        kind, _, expression, valid = RULES[rule]
        m = expression.match(data, at)
        if m:
            ends[rule] = m.end()
            if valid(m):
                found.append((at, m.end(), kind, m.start(2) if kind == "assign" else at))
        elif kind in _RUN:
            ends[rule] = _RUN[kind].match(data, at).end() if data[at : at + 3] == b"eyJ" else ends[rule]
    found += [(a, b, "hex", a) for a, b in _hex_runs(data)]
    found.sort(key=lambda s: (s[0], _RANK[s[2]], s[1]))
    return found


def to_chars(data: bytes, found: list) -> list:
    """Byte spans in code points."""
    if data.isascii():
        return [(a, b, k) for a, b, k, _ in found]
    at = {}
    last, count = 0, 0
    for p in sorted({p for a, b, *_ in found for p in (a, b)}):
        count += len(data[last:p].decode())
        last = p
        at[p] = count
    return [(at[a], at[b], k) for a, b, k, _ in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans as array<struct<kind, start, end>> in code points, end exclusive."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in utf8(b.column(1)):
            found = spans(t)
            out.append([{"kind": k, "start": s, "end": e} for s, e, k in to_chars(t, found)] if found else [])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, make, f"doc_id {id_type(source, 'doc_id')}, spans array<struct<kind:string,start:long,end:long>>")


def mask(data: bytes | None, mark: bytes = b"[REDACTED]") -> bytes | None:
    """The text with every span, of an assignment only its value, replaced; overlapping spans are replaced as one."""
    if not data:
        return data
    merged: list[list[int]] = []
    for a, b in sorted((v, e) for _, e, _, v in spans(data)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if not merged:
        return data
    out, last = [], 0
    for a, b in merged:
        out += [data[last:a], mark]
        last = b
    return b"".join([*out, data[last:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with their secrets masked; length_col, if given, is set to the new length."""
    at, long_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        old = utf8(b.column(at))
        new = [mask(t) for t in old]
        cols = b.columns
        if any(x is not y for x, y in zip(old, new)):
            cols[at] = pa.array(new, pa.binary()).cast(pa.string()).cast(b.schema.field(at).type)
            if long_at is not None:
                lengths = [len(y.decode()) if x is not y else n for x, y, n in zip(old, new, cols[long_at].to_pylist())]
                cols[long_at] = pa.array(lengths, b.schema.field(long_at).type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_rows(docs, make, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
