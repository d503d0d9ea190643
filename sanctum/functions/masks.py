"""Deterministic masks: keyed hashes and placeholders that keep a value's kind.

The key's pads are literals of the plan; never log plans made with a production salt.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def pads(salt: bytes) -> tuple[bytes, bytes]:
    if not salt:
        raise ValueError("the salt is empty")
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def keyed_hash(salt: bytes, value: Column, n: int = 12) -> Column:
    """The first n hex digits of HMAC-SHA-256."""
    inner, outer = pads(salt)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "UTF-8")), 256)
    return F.substring(F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256), 1, n)


def sql_keyed_hash(salt: bytes, value: str, n: int = 12) -> str:
    """The same for DuckDB."""
    inner, outer = pads(salt)
    return f"substr(sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({value})))), 1, {n})"


def value_hash(value: Column) -> Column:
    return F.sha2(F.encode(value, "UTF-8"), 256)


def doc_ipv4(salt: bytes, value: Column) -> Column:
    """An address of the documentation range 203.0.113.1 to .254."""
    return F.concat(F.lit("203.0.113."), (F.conv(keyed_hash(salt, value, 6), 16, 10).cast("int") % 254 + 1).cast("string"))


def doc_ipv6(salt: bytes, value: Column) -> Column:
    return F.concat(F.lit("2001:db8::"), keyed_hash(salt, value, 4))


def mask(salt: bytes, kind: str, value: Column) -> Column:
    """Masks by kind; unknown kinds are masked as secrets."""
    h = lambda n=12: keyed_hash(salt, value, n)
    host = F.concat(h(8), F.lit(".example.invalid"))
    prefixed = {
        "email": "REDACTED_EMAIL_", "person": "ANON_PER_", "per": "ANON_PER_", "PER": "ANON_PER_", "org": "ANON_ORG_", "ORG": "ANON_ORG_", "ORG_NAME": "ANON_ORG_", "secret": "REDACTED_", "SECRET": "REDACTED_",
        "dictionary": "TERM_", "DICTIONARY": "TERM_", "author_name": "Author_", "jwt": "REDACTED_JWT_", "url": "REDACTED_URL_", "PII": "REDACTED_",
    }
    if kind == "phone":
        return F.lit("+0000000000")
    if kind in ("domain", "endpoint", "ENDPOINT"):
        return host
    if kind == "ipv4":
        return doc_ipv4(salt, value)
    if kind == "ipv6":
        return doc_ipv6(salt, value)
    if kind == "ip":
        return F.when(F.contains(value, F.lit(":")), doc_ipv6(salt, value)).otherwise(doc_ipv4(salt, value))
    if kind == "author_email":
        return F.concat(F.lit("author_"), h(), F.lit("@example.invalid"))
    if kind == "scrub_email":
        return F.concat(F.lit("user_"), h(), F.lit("@example.invalid"))
    if kind == "scrub_host":
        return F.concat(h(), F.lit(".example.invalid"))
    return F.concat(F.lit(prefixed.get(kind, "REDACTED_")), h())


def mask_finding(salt: bytes, detector: Column, category: Column, value: Column) -> Column:
    """The mask of a finding: of regular-expression findings the value tells the kind, else the category."""
    m = lambda kind: mask(salt, kind, value)
    quad = (F.size(F.split(value, "[.]")) == 4) & value.rlike(r"^\d+(?:[.]\d+){3}$")
    by_category = F.when(category == "ORG_NAME", m("org")).when(category == "DICTIONARY", m("dictionary")).when(category == "ENDPOINT", m("endpoint")).otherwise(m("secret"))
    by_value = (
        F.when(F.contains(value, F.lit("@")) & F.contains(value, F.lit(".")), m("email"))
        .when(value.rlike(r"^\+\d+$"), m("phone"))
        .when(F.startswith(value, F.lit("eyJ")), m("jwt"))
        .when(F.startswith(value, F.lit("http")), m("url"))
        .when(quad, m("ipv4"))
        .otherwise(by_category)
    )
    ner = F.when(category == "ORG_NAME", m("org")).otherwise(m("person"))
    return F.when(detector == "regex", by_value).when(detector == "ipv6", m("ipv6")).when(detector == "ner", ner).otherwise(by_category)
