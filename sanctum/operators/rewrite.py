"""Rewrites: splicing masks over findings, scrubbing whole texts, brand maps, names of refs.

Two families of masks exist on purpose: findings in a tree (``apply_findings``) and whole-text scrubbing (``scrub``).  Both are
idempotent: what a mask leaves behind is no match again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.masks import doc_ipv4, doc_ipv6, keyed_hash, mask, mask_finding
from ..functions.predicates import contains_mask, in_version_context, is_public_ipv4, is_template, luhn
from ..functions.spans import any_of, bind, disjoint, rewrite, spans, splice
from ..rules import DETECTION_ONLY, RULES, Rule
from .detect import IPV4, IPV6, URL_HOST, guard_of, kept_host, lit_array

#: The order in which whole texts are scrubbed.
ORDER = ["email", "phone", "host", "grouped", "param", "luhn", "named"]
AUTHORITY = r"^((?:[a-zA-Z][+.\w-]*:){1,2}//)(?:([^\s/@]*)@)?(\[[\d.:A-Fa-f]+\]|[^\s#/:?]+)"


def rewritable(category: str | Column) -> Column:
    return ~(F.col(category) if isinstance(category, str) else category).isin(*DETECTION_ONLY)


def edits_of(found: Column, salt: bytes) -> Column:
    """Disjoint edits for an array of findings (detector, category, start, end, value); of overlapping ones the earliest,
    then the longest, stays."""
    kept = disjoint(F.filter(found, lambda f: rewritable(f["category"])))
    return F.transform(kept, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), mask_finding(salt, f["detector"], f["category"], f["value"]).alias("replacement")))


def apply_findings(text: Column, found: Column, salt: bytes) -> Column:
    """The text with its findings masked; texts without any pass untouched."""
    return F.when(F.size(found) > 0, splice(text, edits_of(found, salt))).otherwise(text)


def manifest(targets: DataFrame, found: Column, salt: bytes) -> DataFrame:
    """One row a rewrite: the target's keys, start, end, replacement."""
    keys = [c for c in targets.columns if c not in ("content", "zones")]
    return targets.select(*keys, F.explode(edits_of(found, salt)).alias("e")).select(*keys, "e.start", "e.end", "e.replacement")


# == whole texts ==


def _host_mask(salt: bytes, value: Column, keep: Sequence[str]) -> Column:
    scheme, user, host = (F.regexp_extract(value, AUTHORITY, i) for i in (1, 2, 3))
    has_user = F.contains(F.regexp_extract(value, AUTHORITY, 0), F.lit("@"))
    rest = F.substring(value, F.length(F.regexp_extract(value, AUTHORITY, 0)) + 1, F.length(value))
    masked = F.concat(scheme, keyed_hash(salt, host), F.lit(".example.invalid"), rest)
    untouched = is_template(value) | (host == "") | (~(has_user & (user != "")) & kept_host(host, keep))
    return F.when(untouched, value).otherwise(masked)


def _grouped_mask(salt: bytes, value: Column, rule: Rule) -> Column:
    inner = F.regexp_extract(value, rule.pattern, rule.group)
    head = F.substring(value, F.lit(1), F.length(value) - rule.trail - F.length(inner))
    masked = F.concat(head, F.lit("REDACTED_"), keyed_hash(salt, inner), F.substring(value, F.length(value) - rule.trail + 1, F.lit(rule.trail)))
    return F.when((inner == "") | is_template(inner) | contains_mask(inner), value).otherwise(masked)


def _param_mask(salt: bytes, value: Column) -> Column:
    at = F.instr(value, "=")
    inner = F.substring(value, at + 1, F.length(value))
    return F.when(is_template(inner) | contains_mask(inner), value).otherwise(F.concat(F.substring(value, F.lit(1), at), F.lit("REDACTED_"), keyed_hash(salt, inner)))


def scrub_rule(text: Column, rule: Rule, salt: bytes, keep: Sequence[str] = ()) -> Column:
    """The pass of one rule over whole texts."""
    named = lambda m: F.concat(F.lit(f"REDACTED_{rule.name.upper()}_"), keyed_hash(salt, F.substring(m, 1, 64)))
    by_route = {
        "email": lambda m: mask(salt, "scrub_email", m),
        "phone": lambda m: F.lit("+0000000000"),
        "host": lambda m: _host_mask(salt, m, keep),
        "grouped": lambda m: _grouped_mask(salt, m, rule),
        "param": lambda m: _param_mask(salt, m),
        "luhn": lambda m: F.when(luhn(m), named(m)).otherwise(m),
        "named": named,
    }
    return rewrite(text, rule.pattern, by_route[rule.route], guard_of(rule, text))


def scrub_url_hosts(text: Column, salt: bytes, keep: Sequence[str] = ()) -> Column:
    def one(m):
        scheme, user, host = (F.regexp_extract(m, URL_HOST, i) for i in (1, 2, 3))
        return F.when((user == "") & kept_host(host, keep), m).otherwise(F.concat(scheme, keyed_hash(salt, host), F.lit(".example.invalid")))

    return rewrite(text, URL_HOST, one, F.contains(F.lower(text), F.lit("://")))


def scrub_public_ipv4(text: Column, salt: bytes, keep: Sequence[str] = (), window: int = 28, version_aware: bool = True) -> Column:
    """Public IPv4 addresses to the documentation range; version_aware: but for those in version fields."""
    found = spans(text, IPV4, guard=text.rlike(r"\d[.]\d{1,3}[.]\d{1,3}[.]\d"))
    kept = F.filter(found, lambda s: is_public_ipv4(s["value"]) & ~s["value"].isin(*keep, "") & (~in_version_context(text, s["start"], window) if version_aware else F.lit(True)))
    edits = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), doc_ipv4(salt, s["value"]).alias("replacement")))
    return bind(edits, lambda e: F.when(F.size(e) > 0, splice(text, e)).otherwise(text))


def scrub(df: DataFrame, column: str, salt: bytes, rules: Sequence[Rule] = tuple(RULES), keep: Sequence[str] = (), literals: Iterable[str] = (), persons: Iterable[str] = (), urls: bool = True, public_ips: bool = True) -> DataFrame:
    """A column scrubbed by passes in a fixed order.  Each pass is its own projection, so expressions don't nest."""
    for values, prefix in ((literals, "REDACTED_"), (persons, "ANON_PER_")):
        values = [v for v in values if v]
        if values:
            df = df.withColumn(column, replace_literals(F.col(column), values, salt, prefix))
    for route in ORDER:
        for r in rules:
            if r.route == route:
                df = df.withColumn(column, scrub_rule(F.col(column), r, salt, keep))
    if urls:
        df = df.withColumn(column, scrub_url_hosts(F.col(column), salt, keep))
    if public_ips:
        df = df.withColumn(column, scrub_public_ipv4(F.col(column), salt, keep))
    return df


def replace_literals(text: Column, values: Iterable[str], salt: bytes, prefix: str) -> Column:
    """Literals masked, longest first; identifiers only where they stand alone."""
    out = text
    for v in sorted(set(values), key=lambda v: (-len(v), v)):
        new = F.concat(F.lit(prefix), keyed_hash(salt, F.lit(v)))
        if re.fullmatch(r"[A-Za-z_]\w*", v, re.A):
            out = F.when(F.contains(out, F.lit(v)), F.regexp_replace(out, F.lit(rf"(?<!\w){re.escape(v)}(?!\w)"), new)).otherwise(out)
        else:
            out = F.replace(out, F.lit(v), new)
    return out


def replace_harvest(df: DataFrame, column: str, path: str, salt: bytes, prefix: str) -> DataFrame:
    """A column with the literals of a written table (value) masked, longest first where they overlap at a start; identifiers
    only where they stand alone.  Each worker builds one automaton of them; texts without any pass untouched."""

    def run(texts: pd.Series) -> pd.Series:
        import hashlib
        import hmac

        automaton = _automaton_of(path)
        if automaton is None:
            return texts
        word = re.compile(r"\w", re.A)
        plain = re.compile(r"[A-Za-z_]\w*", re.A)

        def one(text):
            if not text:
                return text
            hits = []
            for end, n in automaton.iter(text):
                s, e = end + 1 - n, end + 1
                if plain.fullmatch(text[s:e]) and (s and word.match(text[s - 1]) or e < len(text) and word.match(text[e])):
                    continue
                hits.append((s, -e))
            out, at = [], 0
            for s, e in sorted(hits):
                if s >= at:
                    out += [text[at:s], prefix, hmac.new(salt, text[s:-e].encode(), hashlib.sha256).hexdigest()[:12]]
                    at = -e
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return df.withColumn(column, F.pandas_udf(run, "string")(F.col(column)))


_AUTOMATA: dict[str, object] = {}


def _automaton_of(path: str):
    if path not in _AUTOMATA:
        import ahocorasick
        import pyarrow.dataset
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        a = ahocorasick.Automaton()
        for batch in pyarrow.dataset.dataset(root, filesystem=fs, format="parquet").to_batches(columns=["value"]):
            for v in batch.column(0).to_pylist():
                a.add_word(v, len(v))
        _AUTOMATA.clear()
        _AUTOMATA[path] = None
        if len(a):
            a.make_automaton()
            _AUTOMATA[path] = a
    return _AUTOMATA[path]


def safe_literals(values: DataFrame, basenames: DataFrame | None = None, declared: DataFrame | None = None, secret: bool = True, column: str = "value") -> DataFrame:
    """Distinct values fit for exact replacement: no dotted versions, bare domains, file names, declared names or, of secrets,
    short or plain identifiers."""
    from ..functions.predicates import entropy

    v = F.col(column)
    identifier = v.rlike(r"^[A-Za-z_]\w*$")
    out = values.select(column).where(v.isNotNull() & (v != "")).distinct()
    out = out.where(~v.rlike(r"^\d+(?:[.]\d+){1,3}$"))
    out = out.where(~(v.rlike(r"^[A-Za-z\d](?:[A-Za-z\d-]{0,61}[A-Za-z\d])?(?:[.][A-Za-z\d](?:[A-Za-z\d-]{0,61}[A-Za-z\d])?)+$") & v.rlike(r"[^\d.]") & (F.length(v) >= 4)))
    if secret:
        out = out.where(~(identifier & ((F.length(v) < 6) | (entropy(v) < 3.2))))
    for other in (basenames, declared):
        if other is not None:
            out = out.join(other.toDF(column).distinct(), column, "left_anti")
    return out


# == brand maps ==


@dataclass(frozen=True)
class Brand:
    pattern: str
    replacement: str
    is_regex: bool = True
    preserve_case: bool = False
    priority: int = 100


def _java(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def match_case(found: Column, replacement: str) -> Column:
    letters = found.rlike(r"\p{L}")
    first, rest = F.substring(found, 1, 1), F.substring(found, F.lit(2), F.length(found))
    titled = (first == F.upper(first)) & (first != F.lower(first)) & rest.rlike(r"\p{L}") & (rest == F.lower(rest))
    return (
        F.when(letters & (found == F.upper(found)) & (found != F.lower(found)), F.lit(replacement.upper()))
        .when(letters & (found == F.lower(found)) & (found != F.upper(found)), F.lit(replacement.lower()))
        .when(titled, F.lit(replacement.capitalize()))
        .otherwise(F.lit(replacement))
    )


def ordered_brands(brands: Iterable[Brand]) -> list[Brand]:
    return sorted((b for b in brands if b.pattern), key=lambda b: (b.priority, -len(b.pattern)))


def apply_brand_map(text: Column, brands: Iterable[Brand]) -> Column:
    """Rules in order of priority, then longest pattern; replacements are never templates."""
    out = text
    for b in ordered_brands(brands):
        pattern = b.pattern if b.is_regex else "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", b.pattern)
        out = rewrite(out, pattern, lambda m, b=b: match_case(m, b.replacement)) if b.preserve_case else F.regexp_replace(out, pattern, _java(b.replacement))
    return out


def brand_collisions(brands: DataFrame) -> DataFrame:
    """(replacement, patterns): replacements of two or more distinct patterns."""
    kept = brands.select(F.trim("replacement").alias("replacement"), "pattern").where("replacement <> '' AND pattern <> ''")
    out = kept.groupBy("replacement").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    return out.where(F.size("patterns") >= 2)


def residual(df: DataFrame, column: str, brands: Iterable[Brand], max_report: int = 50) -> DataFrame:
    """At most max_report rows that still hold a mapped brand."""
    hit = F.lit(False)
    for b in brands:
        hit = hit | F.col(column).rlike(b.pattern if b.is_regex else "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", b.pattern))
    return df.where(hit).limit(max_report)


# == identities, paths and refs ==


def author_name(name: Column, salt: bytes) -> Column:
    return mask(salt, "author_name", name)


def author_email(email: Column, salt: bytes) -> Column:
    return mask(salt, "author_email", email)


def rewrite_path(path: Column, denied: Column, brands: Iterable[Brand]) -> Column:
    """Empty for paths to drop, else the brand map applied."""
    return F.when(denied, "").otherwise(apply_brand_map(path, brands))


def scrubbed_refs(refs: DataFrame, salt: bytes, brands: Iterable[Brand] = (), rules: Sequence[Rule] = tuple(RULES), keep: Sequence[str] = (), name: str = "name") -> DataFrame:
    """refs with ``slug``: the name after brands and whole-text scrubbing, as a valid ref name."""
    out = refs.withColumn("slug", apply_brand_map(F.col(name), brands))
    out = scrub(out, "slug", salt, rules, keep)
    return out.withColumn("slug", ref_slug(F.col("slug"), salt))


def ref_slug(name: Column, salt: bytes) -> Column:
    """A valid ref name of a name already scrubbed: each part reduced to safe signs; names with nothing left get ``branch-`` and
    a hash."""

    def part(p):
        p = F.regexp_replace(p, r"[^\w.+@-]+", "-")
        p = F.regexp_replace(p, r"[.]{2,}", ".")
        p = F.regexp_replace(p, r"@\{", "-")
        p = F.regexp_replace(p, r"^[-.]+|[-.]+$", "")
        return F.regexp_replace(p, r"([.]lock)+$", "")

    parts = F.filter(F.transform(F.split(name, "/"), part), lambda p: p != "")
    joined = F.array_join(parts, "/")
    return F.when((joined == "") | joined.isin("HEAD", "@"), F.concat(F.lit("branch-"), keyed_hash(salt, name))).otherwise(joined)


def disambiguate(df: DataFrame, base: str, order: Sequence[str], out: str = "key") -> DataFrame:
    """base, base-2, base-3, ... for equal names."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def resolve_refs(refs: DataFrame, slug: str = "slug", first: str | None = None, name: str = "name", *, group: str) -> DataFrame:
    """(group, name, slug, ref): collision-free refs within each group, e.g. a repository.  Equal names and names that are a
    folder of another are flattened, then numbered; ``first`` is served before the others."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(_late=f["name"] != (first or "")).sort_values(["_late", "name"], kind="stable")
        used: set[str] = set()
        folders: set[str] = set()
        number: dict[str, int] = {}

        def above(ref):
            return [ref[:i] for i, c in enumerate(ref) if c == "/"]

        def free(ref):
            return ref not in used and ref not in folders and used.isdisjoint(above(ref))

        out = []
        for s in f["slug"]:
            ref = s if free(s) else s.replace("/", "-")
            base = ref
            while not free(ref):
                number[base] = number.get(base, 1) + 1
                ref = f"{base}-{number[base]}"
            used.add(ref)
            folders.update(above(ref))
            out.append(ref)
        return f.assign(ref=out)[["grp", "name", "slug", "ref"]]

    source = refs.select(F.col(group).cast("string").alias("grp"), F.col(name).alias("name"), F.col(slug).alias("slug"))
    return source.groupBy("grp").applyInPandas(run, "grp string, name string, slug string, ref string")


def reconcile(tips: DataFrame, commit_map: DataFrame, in_place: DataFrame) -> DataFrame:
    """(branch, tip): the rewritten tip, else the ref in place, else the old tip; a zero hash means gone."""
    zero = lambda c: F.when(F.col(c).rlike("^0+$"), None).otherwise(F.col(c))
    joined = tips.join(commit_map.toDF("old", "new"), F.col("tip") == F.col("old"), "left").join(in_place.toDF("b", "current"), F.col("branch") == F.col("b"), "left")
    return joined.select("branch", F.coalesce(zero("new"), zero("current"), zero("tip")).alias("tip"))


def scrub_ipv6(df: DataFrame, column: str, salt: bytes) -> DataFrame:
    """Public IPv6 addresses to the documentation range; texts without a candidate stay on the JVM side."""
    import hashlib
    import hmac

    @F.pandas_udf("string")
    def one(texts: pd.Series) -> pd.Series:
        from ..functions.predicates import is_public_ip

        pattern = re.compile(IPV6)
        new = lambda m: "2001:db8::" + hmac.new(salt, m[0].encode(), hashlib.sha256).hexdigest()[:4] if is_public_ip(m[0]) else m[0]
        return texts.map(lambda t: pattern.sub(new, t) if t else t)

    return df.withColumn(column, F.when(F.col(column).rlike(IPV6), one(F.when(F.col(column).rlike(IPV6), F.col(column)))).otherwise(F.col(column)))
