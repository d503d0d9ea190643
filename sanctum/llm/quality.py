r"""Quality rules, lines first.

Each line is judged alone; failing lines are removed; a document is rejected if too little of it remains.  Lines with
words fail for one of:

* ``menu``: two or more separators ``| » › ·`` that stand alone as words;
* ``symbols``: over 30 % of at least four words hold one of ``# * $ % & | < >``;
* ``shouting``: over 30 % of at least four words end in ``!!``;
* ``stutter``: at least ten words of which under 30 % are distinct;
* ``repeat``: equal to an earlier line of the document;
* ``boilerplate``: at most 25 words, at least half of whose signs are a phrase of site navigation or notices, or 40 % two or
  more such phrases; a phrase stands between signs other than letters, digits and ``_``;
* ``fragment``: under ten words and no end punctuation.

A document is kept if the base rules pass (ten words or more; at most 20 % of words in 5-word windows that occur twice)
and the lines that remain hold at least half of the word characters.

Lines are judged by their own words, so a very long text costs in proportion to its length.

Edge cases: a null or empty text has no words and fails; repeated rows are judged alike, each by itself; other columns
are ignored by ``judge`` and kept as they are by ``clean``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, map_rows, read_table, utf8

MIN_WORDS, MAX_REPEAT_PERCENT, MIN_LEFT_PERCENT = 10, 20, 50
SYMBOLS = b"#*$%&|<>"
PHRASES = [
    "javascript", "cookie policy", "use cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "read more", "sign up",
    "sign in", "log in", "subscribe to our", "share this", "skip to content", "lorem ipsum", "politique de confidentialité", "tous droits réservés", "alle rechte vorbehalten",
    "política de privacidad", "todos los derechos reservados",
]


def phrase_pattern(phrases: list[str]) -> re.Pattern | None:
    """The phrases (lower-cased, plain text) in lower-cased UTF-8, none as a part of a word."""
    own = b"|".join(re.escape(p.encode()) for p in phrases)
    return re.compile(rb"(?<![a-z0-9_\x80-\xff])(?:" + own + rb")(?![a-z0-9_\x80-\xff])") if phrases else None


_PHRASE = phrase_pattern(PHRASES)
_SEPARATOR = {b"|", "»".encode(), "›".encode(), "·".encode()}
_END = (b".", b"!", b"?", "…".encode(), b":", b";", b'"', b"'", b")", b"]", "»".encode(), "”".encode(), "’".encode(), "。".encode(), "！".encode(), "？".encode())
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
_LINE_SIGNS = re.compile(rb"[#*$%&|<>!]")


def chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) if data.isascii() else len(data) - len(data) + len(data.translate(None, _CONTINUATION))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window occurring twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == n:
        return 0
    count, covered, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def line_fails(line: bytes, words: list[bytes], phrase: re.Pattern | None = _PHRASE) -> bool:
    """The rules for a line with words, but for ``repeat``, which needs the document."""
    n = len(words)
    if n < 10 and not words[-1].endswith(_END):
        return True
    if n <= 25 and phrase and (found := phrase.findall(line.lower())):
        if 10 * chars(b"".join(found).replace(b" ", b"")) >= (5 if len(found) == 1 else 4) * chars(b"".join(words)):
            return True
    if n >= 10 and 10 * len(set(words)) < 3 * n:
        return True
    if not line.isascii() or _LINE_SIGNS.search(line):
        if sum(w in _SEPARATOR for w in words) >= 2:
            return True
        if n >= 4:
            if 10 * sum(len(w.translate(None, _NOT_SYMBOL)) > 0 for w in words) > 3 * n:
                return True
            if 10 * sum(w.endswith(b"!!") for w in words) > 3 * n:
                return True
    return False


def examine(data: bytes | None, phrase: re.Pattern | None = _PHRASE) -> tuple[int, int, int, int, int, bool, bool, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines that remain."""
    data = data or b""
    words = data.split()
    n, total = len(words), chars(b"".join(words))
    n_symbols = len(data.translate(None, _NOT_SYMBOL))
    dup, lost, seen, left = 0, 0, set(), []
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        if line in seen:
            dup += 1
            bad = True
        else:
            seen.add(line)
            bad = line_fails(line, own, phrase)
        if bad:
            lost += chars(b"".join(own))
        else:
            left.append(line)
    again = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    kept = not base_failed and 100 * (total - lost) >= MIN_LEFT_PERCENT * total
    return n, total, n_symbols, dup, again, base_failed, kept, left


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row per row."""
    phrase = phrase_pattern(phrases)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*(examine(t, phrase)[:7] for t in utf8(b.column(1)))))
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:]]
        return pa.RecordBatch.from_arrays([b.column(0), *arrays], names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, make, f"doc_id {id_type(source, 'doc_id')}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = None, phrases: list[str] = PHRASES) -> DataFrame:
    """The documents kept, failing lines removed from their texts; length_col, if given, is set to the new length."""
    phrase = phrase_pattern(phrases)
    at, long_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, texts = [], []
        for i, t in enumerate(utf8(b.column(at))):
            *_, kept, left = examine(t, phrase)
            if kept:
                keep.append(i)
                texts.append(b"\n".join(left))
        out = b.take(pa.array(keep, pa.int64()))
        cols = out.columns
        cols[at] = pa.array(texts, pa.binary()).cast(pa.string()).cast(b.schema.field(at).type)
        if long_at is not None:
            cols[long_at] = pa.array([chars(t) for t in texts], pa.int64()).cast(b.schema.field(long_at).type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_rows(docs, make, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


#: Signs between words of phrases, doubled in the SQL, which has no lookaround, so that each side of a phrase finds its own.
_BETWEEN = r"[^a-z0-9_\x{80}-\x{10FFFF}]"

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM d WHERE len(w) > 4
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS k FROM g
), c AS (
  SELECT r, count(DISTINCT i + o) AS again FROM h, (SELECT unnest(range(0, 5)) AS o) WHERE k > 1 GROUP BY r
), l AS (
  SELECT r, generate_subscripts(string_split(t, chr(10)), 1) AS pos, unnest(string_split(t, chr(10))) AS line FROM d
), m AS (
  SELECT r, pos, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BETWEEN}', '\0\0', 'g'), '(?:^|{_BETWEEN})({"|".join(PHRASES).replace(" ", "  ")})(?:{_BETWEEN}|$)', 1) AS found
  FROM l
), n AS (
  SELECT r, len(array_to_string(w, '')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS dup,
    (len(w) < 10 AND NOT regexp_matches(w[-1], '[.!?…:;"'')\]»”’。！？]$'))
    OR (len(w) <= 25 AND len(found) > 0 AND 10 * length(replace(array_to_string(found, ''), ' ', '')) >= CASE WHEN len(found) = 1 THEN 5 ELSE 4 END * length(array_to_string(w, '')))
    OR (len(w) >= 10 AND 10 * len(list_distinct(w)) < 3 * len(w))
    OR len(list_filter(w, lambda x: x IN ('|', '»', '›', '·'))) >= 2
    OR (len(w) >= 4 AND 10 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 3 * len(w))
    OR (len(w) >= 4 AND 10 * len(list_filter(w, lambda x: ends_with(x, '!!'))) > 3 * len(w)) AS bad
  FROM m WHERE len(w) > 0
), s AS (
  SELECT r, sum(CASE WHEN dup THEN 1 ELSE 0 END) AS dups, sum(CASE WHEN dup OR bad THEN chars ELSE 0 END) AS lost FROM n GROUP BY r
), f AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * (word_chars - lost) >= {MIN_LEFT_PERCENT} * word_chars AS kept
FROM f
"""
