"""Predicates and checksums as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import bind

#: Code templates: printf verbs and interpolations; they hold no value of their own.
TEMPLATE = r"%[-#0 +']?[*.\d]*[@A-Za-z]|\{\{.*?\}\}|[$#]\{[^}]*\}|\{[\w.]+\}|<[-%./:\w]+>"
#: What the masks leave behind.
MASKED = r"REDACTED_(?:\w+_)?[\da-fA-F]{12}|(?:ANON_(?:ORG|PER)|TERM|Author)_[\da-fA-F]{12}|(?:author|user)_[\da-fA-F]{12}@example[.]invalid"
#: A field that names a version keeps dotted quads in it.
VERSION = r"(?i)assembly|frameworkversion|mscorlib|netcoreapp|netstandard|packageref|<reference|runtimeversion|targetframework|version|\bver\b|v\s*="

#: Networks that are not public: what Python's is_global excludes, as (first, last) of the addresses as integers.
_NOT_GLOBAL = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
_MULTICAST = "224.0.0.0/4"
_GLOBAL_AGAIN = ["192.0.0.9", "192.0.0.10"]
PUBLIC_DNS = ["1.0.0.1", "1.1.1.1", "8.8.4.4", "8.8.8.8"]


def ranges() -> list[tuple[int, int]]:
    nets = [ipaddress.ip_network(n) for n in [*_NOT_GLOBAL, _MULTICAST]]
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets]


def is_template(value: Column) -> Column:
    return value.rlike(TEMPLATE)


def contains_mask(value: Column) -> Column:
    return F.contains(value, F.lit(".example.invalid")) | value.rlike(MASKED)


def in_version_context(text: Column, start: Column, window: int = 48) -> Column:
    """Whether the field before start, at most window signs of it, names a version."""
    first = F.greatest(start - window, F.lit(0))
    before = F.substring(text, first + 1, start - first)
    return F.regexp_replace(before, r"(?s)^.*[)\]};>,\n]", "").rlike(VERSION)


def is_public_ipv4(value: Column) -> Column:
    """Whether a dotted quad is a valid, globally routable address other than well-known DNS."""

    def test(o):
        valid = F.forall(o, lambda x: (F.length(x) <= 3) & ~x.rlike("^0.") & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255))
        n = F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + F.coalesce(x.try_cast("long"), F.lit(0)))
        private = bind(n, lambda v: _in_ranges(v))
        return (F.size(o) == 4) & valid & (~private | value.isin(*_GLOBAL_AGAIN)) & ~value.isin(*PUBLIC_DNS)

    return bind(F.split(value, "[.]"), test)


def _in_ranges(v: Column) -> Column:
    out = F.lit(False)
    for a, b in ranges():
        out = out | v.between(a, b)
    return out


def is_public_ip(value: str, keep: frozenset[str] = frozenset()) -> bool:
    """For Python workers: either version."""
    try:
        ip = ipaddress.ip_address(value)
    except ValueError:
        return False
    return value not in keep and ip.is_global and not ip.is_multicast and str(ip) not in PUBLIC_DNS


def luhn(value: Column, least: int = 12) -> Column:
    """Luhn's check of the digits of value, at least ``least`` of them."""
    digits = F.regexp_replace(value, r"\D", "")
    return (F.length(digits) >= least) & F.call_function("luhn_check", digits)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a sign; of the empty string 0."""

    def of(signs):
        n = F.size(signs)
        share = lambda c: F.size(F.filter(signs, lambda s: s == c)) / n
        return F.aggregate(F.array_sort(F.array_distinct(signs)), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))

    return F.when(F.length(value) > 0, bind(F.split(value, ""), of)).otherwise(F.lit(0.0))


#: Of the last check digit of a taxpayer number; those before it use the tail.
WEIGHTS = [int(x, 16) for x in "372 4a3 594 68".replace(" ", "")]


def _weighted(d: Column, weights: list[int]) -> Column:
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.zip_with(F.slice(d, 1, len(weights)), w, lambda a, b: a * b), F.lit(0), lambda a, x: a + x) % 11 % 10


def ru_legal_id(value: Column) -> Column:
    """Validity of a Russian taxpayer or registration number of 10, 12, 13 or 15 digits by its check digits."""

    def test(d):
        n = F.size(d)
        at = lambda i: d[i]
        head = lambda k: F.substring(value, 1, k).cast("long")
        year = F.substring(value, 2, 2).cast("int")
        years = year.between(1, 35) | year.between(93, 99)
        ten = _weighted(d, WEIGHTS[2:]) == at(9)
        twelve = (_weighted(d, WEIGHTS[1:]) == at(10)) & (_weighted(d, WEIGHTS) == at(11))
        thirteen = years & (head(12) % 11 % 10 == at(12).cast("long"))
        fifteen = years & (head(14) % 13 % 10 == at(14).cast("long"))
        same = F.size(F.array_distinct(d)) == 1
        return ~same & F.when(n == 10, ten).when(n == 12, twelve).when(n == 13, thirteen).when(n == 15, fifteen).otherwise(F.lit(False))

    digits = F.transform(F.split(value, ""), lambda c: c.cast("int"))
    return F.when(value.rlike(r"^\d{10}(?:\d{2,3}|\d{5})?$"), bind(digits, test)).otherwise(F.lit(False))


def suffixes(host: Column) -> Column:
    """A host and its dotted suffixes."""
    return bind(F.split(host, "[.]"), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def is_listed(host: Column, listed: Column) -> Column:
    """Whether host, or a dotted suffix of it, is in the array."""
    return F.arrays_overlap(suffixes(host), listed)
