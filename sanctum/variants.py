"""Spellings of a term: separators, casings, transliteration, and text read in the wrong encoding.

Terms are expanded when rules are loaded; scans only see the result.
"""

from __future__ import annotations

import re

SEPARATORS = ["", " ", "-", "_", "."]
_TO_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))
_TO_CYRILLIC = dict(zip("abvgdeziyklmnoprstufhcjqwx", "абвгдезийклмнопрстуфхкжквх")) | dict(x.split(":") for x in "ch:ч kh:х sh:ш shch:щ ts:ц ya:я yo:ё yu:ю zh:ж".split())
_LATIN_UNIT = re.compile("|".join(sorted(_TO_CYRILLIC, key=len, reverse=True)))
_WORDS = re.compile(r"[A-ZА-ЯЁ]+(?![a-zа-яё])|[A-ZА-ЯЁ]?[a-zа-яё]+|\d+")
LATIN, CYRILLIC = (re.compile(f"[{signs}]", re.I) for signs in ("a-z", "а-яё"))


def words(term: str) -> list[str]:
    return [w for part in re.split(r"[\s._-]+", term) for w in (_WORDS.findall(part) or ([part] if part else []))]


def casings(text: str) -> set[str]:
    return {text.lower(), text.upper(), text.title()}


def transliterate(text: str) -> str | None:
    """To the other script; None for short or mixed text."""
    latin, cyrillic = bool(LATIN.search(text)), bool(CYRILLIC.search(text))
    if latin == cyrillic or len(text) < 4:
        return None
    low = text.lower()
    if cyrillic:
        return "".join(_TO_LATIN.get(c, c) for c in low)
    return _LATIN_UNIT.sub(lambda m: _TO_CYRILLIC[m[0]], low)


def mojibake(text: str) -> str | None:
    """UTF-8 read as cp1251, unless signs are lost."""
    if text.isascii():
        return None
    out = str(text.encode(), "cp1251", "replace")
    return None if "�" in out else out


def expand(term: str) -> set[str]:
    """All forms of a term, itself among them."""
    if not (term := term.strip()):
        return set()
    out = {term}
    for base in filter(None, (term, transliterate(term))):
        parts = words(base)
        out.add(base)
        for s in SEPARATORS:
            joined = s.join(parts)
            out |= casings(joined)
    return out | {m for m in map(mojibake, list(out)) if m}


def brand_terms(dictionaries: dict[str, tuple[str, ...]]) -> list[str]:
    """Lower-cased forms of all terms but kept ones and domains; forms of kept terms are left out."""
    kept = {v.lower() for t in dictionaries.get("keep", ()) for v in expand(t)}
    seen: dict[str, None] = {}
    for name, terms in dictionaries.items():
        if name not in ("keep", "domains"):
            for t in terms:
                for v in sorted(expand(t)):
                    if v.lower() not in kept:
                        seen.setdefault(v.lower())
    return list(seen)
