"""Zones: the intervals of a text that a scan may look at."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import merge_zones, spans

COMMENTS = [r"(?m)#[^\n]*$", r"(?m)//[^\n]*$", r"(?m)--[^\n]*$"]
SEMICOLON = r"(?m);[^\n]*$"
ZONES = "array<struct<start:int,end:int>>"
IMPORTS = r"(?m)^[ \t]*(?:from|import|include|namespace|package|require|use|using)\b[^\n]*$"
#: Extension -> family of comment and string syntax.
FAMILIES = {
    "hash": "py pyi rb sh bash zsh pl pm r jl yml yaml toml ini cfg conf tf ex exs nim cr mk dockerfile",
    "slash": "js jsx ts tsx java kt kts scala c h cc cpp hpp cs go rs swift php dart m mm groovy gradle proto sol zig v",
    "dash": "sql lua hs elm ada adb ads vhd vhdl",
    "semicolon": "lisp el clj cljs scm rkt asm s ini",
    "markup": "html htm xml svg vue svelte xaml",
}
LANGUAGE = {ext: family for family, exts in FAMILIES.items() for ext in exts.split()}


def comment_zones(text: Column, patterns: list[str] | None = None) -> Column:
    """Line comments by pattern, merged."""
    found = [F.transform(spans(text, p), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for p in patterns or COMMENTS]
    return merge_zones(F.concat(*found))


def import_spans(text: Column) -> Column:
    """Lines that import or declare packages."""
    return F.transform(spans(text, IMPORTS), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def family(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[.]([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, exts in FAMILIES.items():
        out = F.when(ext.isin(*exts.split()), F.lit(name)).otherwise(out)
    return out


_STRING = r"'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\""
_LEXERS = {
    "hash": re.compile(rf"(?P<string>{_STRING})|(?P<comment>#[^\n]*)", re.S),
    "slash": re.compile(rf"(?P<string>{_STRING}|`(?:[^`\\]|\\.)*`)|(?P<comment>//[^\n]*|/\*.*?\*/)", re.S),
    "dash": re.compile(rf"(?P<string>{_STRING})|(?P<comment>--[^\n]*|/\*.*?\*/)", re.S),
    "semicolon": re.compile(r"(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<comment>;[^\n]*)", re.S),
    "markup": re.compile(r"(?P<string>(?!))|(?P<comment><!--.*?-->)", re.S),
}


def lexer_zones(text: str, family: str, strings: bool = True, least: int = 3) -> list[tuple[int, int]]:
    """Comments, and strings of at least ``least`` signs, by a lexer; an approximation of a parser's nodes."""
    out = []
    for m in _LEXERS[family].finditer(text):
        if m.lastgroup == "comment" or strings and m.end() - m.start() >= least:
            if out and m.start() <= out[-1][1]:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
    return out


def code_zones(targets: DataFrame, on_error: str = "fallback", strings: bool = True) -> DataFrame:
    """Targets with the zones of their language.  Of unknown languages, or if the lexer fails: ``fallback`` null zones,
    ``skip`` none, ``fail`` an error."""
    if on_error not in ("fallback", "skip", "fail"):
        raise ValueError(on_error)

    @F.pandas_udf(ZONES)
    def lex(texts: pd.Series, families: pd.Series) -> pd.Series:
        def one(t, f):
            if t is None or f is None:
                if on_error == "fail" and t is not None:
                    raise ValueError("unknown language")
                return None if on_error == "fallback" else []
            return [{"start": a, "end": b} for a, b in lexer_zones(t, f, strings)]

        return pd.Series([one(t, f) for t, f in zip(texts, families)])

    return targets.withColumn("zones", lex("content", family(F.col("path"))))


def char_offset(data: Column, byte_offset: Column) -> Column:
    """A byte offset into UTF-8 data in code points."""
    return F.length(F.decode(F.substring(data, F.lit(1), byte_offset), "UTF-8"))
