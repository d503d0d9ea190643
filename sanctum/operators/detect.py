"""Detectors: column expressions from text to spans, and the findings they make.

Targets are rows (scope, object_id, path, content, zones).  Null zones are no restriction; an empty array lets nothing
through.  All rules of a scan are one projection over the text: no shuffle, and no text leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import value_hash
from ..functions.predicates import MASKED as MASKED_VALUE
from ..functions.predicates import TEMPLATE, contains_mask, entropy, in_version_context, is_listed, is_public_ip, is_public_ipv4, is_template, luhn, ru_legal_id
from ..functions.spans import any_of, bind, inside, line_of, quoted, spans, spans_sql
from ..rules import GENERIC_INTERNAL, GENERIC_LABELS, HOST_RULES, INTERNAL_TLDS, LEGAL_FORMS, UNIVERSAL_HOSTS, Rule, Rulepack

FOUND = "array<struct<detector:string,rule:string,category:string,severity:string,start:int,end:int,value:string>>"
IPV4 = r"(?<![.\w])\d{1,3}(?:[.]\d{1,3}){3}(?![.\w])"
URL_HOST = r"(?i)(https?://)(?:([^\s\"'/<>@]*)@)?(\[[\d.:a-f]+\]|[^\s\"'#/:<>?\\]+)"
DOMAIN = r"\b(?:[A-Za-z\d](?:[A-Za-z\d-]{0,61}[A-Za-z\d])?[.])+[A-Za-z]{2,}\b"
DIGIT_RUN = r"(?<![.\w])\d{10}(?:\d{5}|\d{2,3})?(?![.\w])"


def lit_array(values: Sequence[str]) -> Column:
    return F.expr(f"array({', '.join(map(quoted, values))})") if values else F.array().cast("array<string>")


def guard_of(rule: Rule, text: Column) -> Column | None:
    """A test that any text with a match of the rule passes; a rule with neither literals nor a cheap pattern has none."""
    if not rule.guard:
        return text.rlike(rule.scan) if rule.scan else None
    return bind(F.lower(text), lambda low: any_of(low, rule.guard)) if rule.fold else any_of(text, rule.guard)


def kept_host(host: Column, keep: Sequence[str] = ()) -> Column:
    """Whether a URL's host names nobody: kept, not public, a generic single label, or universal infrastructure."""
    h = F.regexp_replace(F.lower(F.trim(host)), r"^\[|\]$", "")

    def test(h):
        quad = h.rlike(r"^\d{1,3}([.]\d{1,3}){3}$")
        kept = is_listed(h, lit_array(keep)) if keep else F.lit(False)
        known = F.when(F.contains(h, F.lit(".")), is_listed(h, lit_array(UNIVERSAL_HOSTS))).otherwise(F.array_contains(lit_array(GENERIC_LABELS), h))
        return (h == "") | kept | F.when(quad, ~is_public_ipv4(h)).otherwise(known)

    return bind(h, test)


def _found(found: Column, detector: str, rule: Column | str, category: str, severity: str) -> Column:
    name = F.lit(rule) if isinstance(rule, str) else rule
    return F.transform(found, lambda s: F.struct(F.lit(detector).alias("detector"), name.alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def names_somebody(connection: Column, keep: Sequence[str] = ()) -> Column:
    """Whether a connection string has user info or a host that isn't kept."""
    host = F.regexp_extract(connection, r"^[^/]*//(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)
    return F.contains(connection, F.lit("@")) | ~kept_host(host, keep)


def rule_spans(text: Column, rule: Rule, zones: Column | None = None, keep: Sequence[str] = (), whole: bool = True) -> Column:
    """Spans of a rule, but for values that are templates or masked already, cards that fail Luhn's check, and
    connection strings to kept hosts.  whole: the span of the match rather than of its group."""
    found = spans(text, rule.pattern, 0 if whole else rule.group, 0 if whole else rule.trail, guard_of(rule, text))

    def test(s):
        ok = ~contains_mask(s["value"]) & ~is_template(s["value"])
        if rule.route == "luhn":
            ok = ok & luhn(s["value"])
        if rule.name in HOST_RULES:
            ok = ok & names_somebody(s["value"], keep)
        if zones is not None:
            ok = ok & inside(s, zones)
        return ok

    return F.filter(found, test)


def _guard_sql(rule: Rule, text: str) -> str:
    if not rule.guard:
        return f"{text} RLIKE {quoted(rule.scan)}" if rule.scan else "true"
    hits = lambda x: " OR ".join(f"contains({x}, {quoted(g)})" for g in rule.guard)
    return f"exists(array(lower({text})), l -> {hits('l')})" if rule.fold else f"({hits(text)})"


def regex_detector(text: str, pack: Rulepack, zones: str | None = None) -> Column:
    """The rules' findings, as ``rule_spans`` has them.  text and zones are names of columns: a scan has some forty rules, and
    each is one expression of SQL text."""
    parts = []
    for r in pack.rules:
        tests = [f"NOT (contains(s.value, '.example.invalid') OR s.value RLIKE {quoted(MASKED_VALUE)} OR s.value RLIKE {quoted(TEMPLATE)})"]
        if zones:
            tests.append(f"({zones} IS NULL OR coalesce(exists({zones}, z -> z.start <= s.start AND s.end <= z.end), false))")
        kind = f"'regex' AS detector, {quoted(r.name)} AS rule, '{r.category}' AS category, '{r.severity}' AS severity"
        found = F.expr(f"transform(filter({spans_sql(text, r.pattern, _guard_sql(r, text))}, s -> {' AND '.join(tests)}), s -> struct({kind}, s.start AS start, s.end AS end, s.value AS value))")
        if r.route == "luhn":
            found = F.filter(found, lambda s: luhn(s["value"]))
        if r.name in HOST_RULES:
            found = F.filter(found, lambda s: names_somebody(s["value"], pack.keep))
        parts.append(found)
    return F.concat(*parts) if parts else F.array().cast(FOUND)


def legal_id_detector(text: Column, zones: Column | None = None) -> Column:
    found = spans(text, DIGIT_RUN, guard=text.rlike(r"\d{10}"))
    ok = F.filter(found, lambda s: ru_legal_id(s["value"]) & (inside(s, zones) if zones is not None else F.lit(True)))
    return _found(ok, "legal_id", "ru_legal_id", "PII", "HIGH")


def public_ip_spans(text: Column, keep: Sequence[str] = (), window: int = 48) -> Column:
    """Public IPv4 addresses outside version fields."""
    found = spans(text, IPV4, guard=text.rlike(r"\d[.]\d{1,3}[.]\d{1,3}[.]\d"))
    return F.filter(found, lambda s: is_public_ipv4(s["value"]) & ~s["value"].isin(*keep, "") & ~in_version_context(text, s["start"], window))


def url_host_spans(text: Column, keep: Sequence[str] = ()) -> Column:
    """User info and host of URLs that have user info or whose host isn't kept; bare addresses are left to their own
    detector."""
    found = spans(text, URL_HOST, guard=F.contains(F.lower(text), F.lit("://")))

    def cut(s):
        scheme, user, host = (F.regexp_extract(s["value"], URL_HOST, i) for i in (1, 2, 3))
        start = s["start"] + F.length(scheme) + F.when(user == "", F.length(s["value"]) - F.length(scheme) - F.length(host)).otherwise(0)
        address = F.regexp_replace(host, r"^\[|\]$", "").rlike(r"^(\d{1,3}([.]\d{1,3}){3}|[\da-fA-F:]*:[\da-fA-F:.]*)$")
        return F.struct(start.alias("start"), s["end"].alias("end"), F.substring(s["value"], start - s["start"] + 1, s["end"] - start).alias("value"), ((user != "") | (~address & ~kept_host(host, keep))).alias("flag"))

    cuts = F.filter(F.transform(found, cut), lambda s: s["flag"])
    return F.transform(cuts, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def domain_spans(text: Column, domains: Sequence[str] = (), keep: Sequence[str] = ()) -> Column:
    """Domains under an internal ending or in the list, generic and kept ones left out."""
    found = spans(text, DOMAIN, guard=F.contains(text, F.lit(".")))

    def test(s):
        d = F.lower(s["value"])
        internal = F.regexp_extract(d, r"([^.]*)$", 1).isin(*INTERNAL_TLDS)
        listed = is_listed(d, lit_array(domains)) if domains else F.lit(False)
        kept = is_listed(d, lit_array(keep)) if keep else F.lit(False)
        return (internal | listed) & ~kept & ~d.isin(*GENERIC_INTERNAL) & ~F.endswith(d, F.lit(".svc.cluster.local"))

    return F.filter(found, test)


def endpoint_detector(text: Column, pack: Rulepack, zones: Column | None = None, window: int = 48) -> Column:
    """Addresses, domains and URL hosts; of those within another only the widest."""
    parts = [
        _found(public_ip_spans(text, pack.keep, window), "endpoint", "public_ip", "ENDPOINT", "HIGH"),
        _found(domain_spans(text, pack.domains, pack.keep), "endpoint", "domain", "ENDPOINT", "MEDIUM"),
        _found(url_host_spans(text, pack.keep), "endpoint", "url_host", "ENDPOINT", "MEDIUM"),
    ]
    found = F.concat(*parts)
    if zones is not None:
        found = F.filter(found, lambda s: inside(s, zones))
    return drop_contained(found)


RANK = {"public_ip": 0, "domain": 1, "url_host": 2}


def drop_contained(found: Column) -> Column:
    """Spans not contained in one that starts earlier, is longer, or is of a kind that goes first."""
    rank = lambda s: F.when(s["rule"] == "public_ip", 0).when(s["rule"] == "domain", 1).otherwise(2)
    ordered = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(rank(a) - rank(b)))

    def step(acc, s):
        return F.when(s["end"] <= acc["most"], acc).otherwise(F.struct(s["end"].alias("most"), F.concat(acc["out"], F.array(s)).alias("out")))

    return F.aggregate(ordered, F.struct(F.lit(-1).alias("most"), F.slice(found, F.lit(1), F.lit(0)).alias("out")), step, lambda acc: acc["out"])


def contained_window(findings: DataFrame, *keys: str) -> DataFrame:
    """The same over rows: drop a row if an earlier one of its text ends at or after its end."""
    order = [F.col("start"), F.desc("end"), F.col("rank")]
    before = F.max("end").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return findings.withColumn("_most", before).where("_most IS NULL OR _most < end").drop("_most")


def dictionary_spans(text: Column, term: Column) -> Column:
    """All, also overlapping, places of a term in the lower-cased text."""
    low = F.lower(text)
    # a lookahead counts overlapping places; each is then located from the one before
    n = F.when(F.contains(low, term), F.regexp_count(low, F.concat(F.lit("(?=\\Q"), term, F.lit("\\E)")))).otherwise(0)

    def step(acc, _):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1))
        return F.concat(acc, F.array(F.call_function("locate", term, low, last + 2) - 1))

    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    places = F.aggregate(steps, F.array().cast("array<int>"), step)
    return F.transform(places, lambda p: F.struct(p.alias("start"), (p + F.length(term)).alias("end"), F.substring(text, p + 1, F.length(term)).alias("value")))


def dictionary_findings(targets: DataFrame, terms: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """(target columns, dict, term, start, end, value) for terms (dict, lower-cased term), by one automaton a worker."""
    kept = {k.lower() for k in keep}
    wanted = [(d, t.lower()) for d, t in terms if t and t.lower() not in kept]
    columns = [c for c in targets.columns if c not in ("content", "zones")]
    fields = ", ".join(f"{c} {targets.schema[c].dataType.simpleString()}" for c in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        by_term: dict[str, list[str]] = {}
        for d, t in wanted:
            by_term.setdefault(t, []).append(d)
        for t, ds in by_term.items():
            a.add_word(t, (t, ds))
        if by_term:
            a.make_automaton()
        for f in frames:
            at, out = [], []
            for i, text in enumerate(f["content"]):
                if not text or not by_term:
                    continue
                for end, (t, ds) in a.iter(text.lower()):
                    start = end + 1 - len(t)
                    for d in ds:
                        at.append(i)
                        out.append((d, t, start, end + 1, text[start : end + 1]))
            hits = pd.DataFrame(out, columns=["dict", "term", "start", "end", "value"])
            yield pd.concat([f.iloc[at][columns].reset_index(drop=True), hits], axis=1)

    return targets.mapInPandas(run, f"{fields}, dict string, term string, start int, end int, value string")


def brand_detector(text: Column, path: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """Brand terms in code, outside strings and comments: within imports and package declarations PACKAGE_NAMESPACE, else
    BRAND_IDENTIFIER.  Files of unknown languages have no code to tell from prose."""
    terms = sorted({t.lower() for _, t in terms if t})

    def run(texts: pd.Series, families: pd.Series) -> pd.Series:
        import re

        import ahocorasick

        from .zones import IMPORTS, lexer_zones

        a, imports = ahocorasick.Automaton(), re.compile(IMPORTS)
        for t in terms:
            a.add_word(t, len(t))
        a.make_automaton()
        out = []
        for text, family in zip(texts, families):
            found = []
            hits = [(end + 1 - n, end + 1) for end, n in a.iter(same_length_lower(text))] if text and family else []
            if hits:
                skip, packages = lexer_zones(text, family), [m.span() for m in imports.finditer(text)]
                for s, e in hits:
                    if not _within(s, e, skip):
                        category = "PACKAGE_NAMESPACE" if _within(s, e, packages) else "BRAND_IDENTIFIER"
                        found.append({"detector": "brand", "rule": "term", "category": category, "severity": "HIGH", "start": s, "end": e, "value": text[s:e]})
            out.append(found)
        return pd.Series(out, index=texts.index, dtype=object)

    from .zones import family

    run.__annotations__ = {"texts": pd.Series, "families": pd.Series, "return": pd.Series}
    return F.coalesce(F.pandas_udf(run, FOUND)(text, family(path)), F.array().cast(FOUND))


def _within(start: int, end: int, zones: list[tuple[int, int]]) -> bool:
    """Whether a span lies in one of the sorted, disjoint zones."""
    from bisect import bisect_right

    i = bisect_right(zones, (start, float("inf"))) - 1
    return i >= 0 and end <= zones[i][1]


def same_length_lower(text: str) -> str:
    """Lower case sign by sign: those that would become two stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def path_findings(targets: DataFrame, pack: Rulepack) -> DataFrame:
    """Brand terms in the targets' paths, each (prefix, term) of a scope once, as rows of ``findings``."""
    paths = targets.select("scope", "path").where("path is not null").distinct()
    wanted = F.explode(lit_array([t for _, t in pack.terms()])).alias("term")
    parts = paths.select("scope", "path", F.posexplode(F.split("path", "/")).alias("pos", "part"))
    hits = parts.select("*", wanted).where(F.contains(F.lower("part"), F.col("term")))
    prefix = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("pos") + 1), "/")
    own = hits.select("scope", "path", prefix.alias("prefix"), "part", "term").groupBy("scope", "prefix", "term").agg(F.min("path").alias("path"), F.first("part").alias("part"))
    start = (F.length("prefix") - F.length("part") + F.call_function("locate", F.col("term"), F.lower("part")) - 1).cast("int")
    value = F.substring("path", start + 1, F.length("term"))
    return own.select("scope", F.lit(None).cast("string").alias("object_id"), "path", F.lit("path").alias("detector"), F.lit("term").alias("rule"), F.lit("BRAND_PATH").alias("category"), F.lit("HIGH").alias("severity"), F.lit(0).alias("line"), start.alias("offset_start"), (start + F.length("term")).cast("int").alias("offset_end"), value.alias("matched_value"), value_hash(value).alias("value_hash"))


def path_brand_findings(paths: DataFrame, terms: Sequence[str], path_col: str = "path") -> DataFrame:
    """(path, prefix, value): brand terms in the parts of paths, once for each (prefix through the part, term)."""
    wanted = F.explode(lit_array([t.lower() for t in terms])).alias("term")
    parts = paths.select(F.col(path_col).alias("path"), F.posexplode(F.split(path_col, "/")).alias("pos", "part"))
    hits = parts.select("path", "pos", "part", wanted).where(F.contains(F.lower("part"), F.col("term")))
    prefix = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("pos") + 1), "/")
    return hits.select("path", prefix.alias("prefix"), F.col("term").alias("value")).groupBy("prefix", "value").agg(F.min("path").alias("path")).select("path", "prefix", "value")


def brand_category(span: Column, skip: Column, packages: Column) -> Column:
    """Of a brand term in code: null within strings and comments, PACKAGE_NAMESPACE within imports, else BRAND_IDENTIFIER."""
    within = lambda zones: F.coalesce(F.exists(zones, lambda z: (z["start"] <= span["start"]) & (span["end"] <= z["end"])), F.lit(False))
    return F.when(within(skip), F.lit(None)).when(within(packages), "PACKAGE_NAMESPACE").otherwise("BRAND_IDENTIFIER")


def kept_org(name: Column, keep: Sequence[str]) -> Column:
    """Whether an organisation is kept: by its name, or all of two or more tokens but legal forms are kept."""
    k = lit_array([x.lower() for x in keep])

    def test(n):
        tokens = F.filter(F.split(F.regexp_replace(n, r"[^\w\sЀ-ӿ-]", " "), r"\s+"), lambda t: t != "")
        core = F.filter(tokens, lambda t: ~t.isin(*LEGAL_FORMS))
        return F.array_contains(k, n) | ((F.size(tokens) >= 2) & (F.size(core) > 0) & F.forall(core, lambda t: F.array_contains(k, t)))

    return bind(F.lower(F.trim(name)), test)


def chunks(text: str, size: int = 2000, overlap: int = 3) -> list[tuple[int, str]]:
    """(offset, chunk) of at most size signs, cut at lines, with the last lines of one chunk at the head of the next; a
    line that is too long is cut at its last space."""
    lines: list[tuple[int, str]] = []
    at = 0
    for line in text.splitlines(keepends=True):
        while len(line) > size:
            cut = line.rfind(" ", 1, size)
            cut = cut + 1 if cut > 0 else size
            lines.append((at, line[:cut]))
            at, line = at + cut, line[cut:]
        if line:
            lines.append((at, line))
            at += len(line)
    out, own = [], []
    for piece in lines:
        if own and sum(len(x) for _, x in own) + len(piece[1]) > size:
            out.append((own[0][0], "".join(x for _, x in own)))
            own = own[-overlap:] if overlap else []
            while own and sum(len(x) for _, x in own) + len(piece[1]) > size:
                own.pop(0)
        own.append(piece)
    if own:
        out.append((own[0][0], "".join(x for _, x in own)))
    return out


def chunk_rows(targets: DataFrame, id_col: str, text_col: str = "content", size: int = 2000, overlap: int = 3) -> DataFrame:
    """(id, offset, chunk)."""

    source = targets.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, held, kind = [], 0, b.schema.field("id").type
            for k in range(b.num_rows):  # one text at a time, and never more than CHUNK_CHARS of chunks
                i = b.column(0)[k].as_py()
                for o, c in chunks(b.column(1)[k].as_py() or "", size, overlap):
                    rows.append((i, o, c))
                    held += len(c)
                    if held >= CHUNK_CHARS:
                        yield _chunk_batch(pa, rows, kind)
                        rows, held = [], 0
            yield _chunk_batch(pa, rows, kind)

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, offset int, chunk string")


#: Signs of chunks that a worker of ``chunk_rows`` holds before it hands them on.
CHUNK_CHARS = 1 << 20


def _chunk_batch(pa, rows, kind):
    ids, offsets, texts = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(offsets, pa.int32()), pa.array(texts, pa.string())], names=["id", "offset", "chunk"])


#: A model: texts -> for each a list of (label, score, start, end).
Model = Callable[[list[str]], list[list[tuple[str, float, int, int]]]]


def capitalised_model(texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
    """A stand-in for a model: honorific and capitalised words are persons, names with a legal form organisations."""
    import re

    person = re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Prof)\.? ([A-ZЀ-Я][\w-]+(?: [A-ZЀ-Я][\w-]+)?)")
    org = re.compile(r"\b(?:[A-Z][\w-]+ ){1,3}(?:Corp|GmbH|Inc|LLC|Ltd|PLC)\b")
    return [[("PER", 0.9, *m.span(1)) for m in person.finditer(t)] + [("ORG", 0.8, *m.span()) for m in org.finditer(t)] for t in texts]


def ner_findings(targets: DataFrame, id_col: str, model: Model = capitalised_model, labels: Sequence[str] = ("PER", "ORG"), min_score: float = 0.5, min_length: int = 3, keep: Sequence[str] = (), batch: int = 32) -> DataFrame:
    """(id, label, category, severity, start, end, value): entities of chunked texts, each span once.  The chunks of a batch
    of rows go through the model together."""
    kept = {k.lower() for k in keep}

    def run(frames):
        for f in frames:
            rows = []
            parts = [(i, t, o, c) for i, t in zip(f["id"], f["text"]) for o, c in chunks(t or "")]
            seen = set()
            for k in range(0, len(parts), batch):
                some = parts[k : k + batch]
                for (i, t, o, c), found in zip(some, model([c for *_, c in some])):
                    for label, score, a, b in found:
                        value = t[o + a : o + b]
                        if label in labels and score >= min_score and len(value.strip()) >= min_length and value.lower() not in kept and (i, o + a, o + b) not in seen:
                            seen.add((i, o + a, o + b))
                            rows.append((i, label, "ORG_NAME" if label == "ORG" else "PII", "MEDIUM" if label == "ORG" else "HIGH", o + a, o + b, value))
            yield pd.DataFrame(rows, columns=["id", "label", "category", "severity", "start", "end", "value"])

    source = targets.select(F.col(id_col).alias("id"), F.col("content").alias("text"))
    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, label string, category string, severity string, start int, end int, value string")


IPV6 = r"(?<![.:\w])(?:[A-Fa-f\d]{0,4}:){2,7}[A-Fa-f\d]{0,4}(?![.:\w])"


def ipv6_findings(targets: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, start, end, value): public IPv6 addresses; only texts with a candidate go to Python."""
    kept = frozenset(keep)
    source = targets.select(F.col(id_col).alias("id"), F.col("content").alias("text")).where(F.col("text").rlike(IPV6))

    def run(frames):
        import re

        pattern = re.compile(IPV6)
        for f in frames:
            rows = [(i, m.start(), m.end(), m[0]) for i, t in zip(f["id"], f["text"]) for m in pattern.finditer(t) if is_public_ip(m[0], kept)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "value"])

    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, start int, end int, value string")


def entropy_of(values: DataFrame, column: str = "value") -> DataFrame:
    return values.withColumn("entropy", F.round(entropy(F.col(column)), 6))


#: Of a scan; the dictionary, brand and path detectors look for the rulepack's terms, the entity detector needs a model.
DETECTORS = ("regex", "legal_id", "endpoint", "ipv6", "dictionary", "brand", "path", "ner")
#: Masks of findings, in which terms and entities aren't looked for.
MASKED = r"(?:TERM|REDACTED(?:_[A-Z]+)?|ANON_(?:PER|ORG))_[\da-f]{12}|[\da-f]{8,12}[.]example[.]invalid|2001:db8::[\da-f]{4}"


def in_python(text: Column, find: Callable[[list[str]], list[list[tuple]]]) -> Column:
    """Findings of a function from texts to lists of findings; nulls aren't given to it."""

    def run(texts: pd.Series) -> pd.Series:
        given = [i for i, t in enumerate(texts) if t is not None]
        out = [[] for _ in texts]
        names = ("detector", "rule", "category", "severity", "start", "end", "value")
        for i, found in zip(given, find([texts.iloc[i] for i in given])):
            out[i] = [dict(zip(names, f)) for f in found]
        return pd.Series(out, index=texts.index, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.coalesce(F.pandas_udf(run, FOUND)(text), F.array().cast(FOUND))


def ipv6_detector(text: Column, keep: Sequence[str] = ()) -> Column:
    """Public IPv6 addresses; only texts with a candidate go to Python."""
    kept = frozenset(keep)

    def find(texts):
        import re

        pattern = re.compile(IPV6)
        return [[("ipv6", "public_ip", "ENDPOINT", "HIGH", m.start(), m.end(), m[0]) for m in pattern.finditer(t) if is_public_ip(m[0], kept)] for t in texts]

    return in_python(F.when(text.rlike(IPV6), text), find)


def dictionary_detector(text: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """All places of terms (dictionary, lower-cased term) by one automaton a batch, but for those within masks."""
    terms = [(d, t) for d, t in terms if t]

    def find(texts):
        import re

        import ahocorasick

        a, masked, out = ahocorasick.Automaton(), re.compile(MASKED), []
        for d, t in terms:
            a.add_word(t, (t, d))
        a.make_automaton()
        for text in texts:
            low = same_length_lower(text)
            hits = [(end + 1 - len(t), end + 1, d) for end, (t, d) in a.iter(low)]
            masks = [m.span() for m in masked.finditer(text)] if hits else []
            out.append([("dictionary", d, "DICTIONARY", "HIGH", s, e, text[s:e]) for s, e, d in hits if not any(x <= s and e <= y for x, y in masks)])
        return out

    return in_python(text, find)


def ner_detector(text: Column, model: Model, pack: Rulepack, labels: Sequence[str] = ("PER", "ORG"), batch: int = 32) -> Column:
    """Entities of chunked texts, each span once, but for those within masks."""
    least, length, kept = pack.policies.min_score, pack.policies.min_person_length, set(pack.keep)

    def find(texts):
        import re

        masked, out = re.compile(MASKED), [{} for _ in texts]
        parts = [(i, o, c) for i, t in enumerate(texts) for o, c in chunks(t)]
        for k in range(0, len(parts), batch):
            some = parts[k : k + batch]
            for (i, o, c), found in zip(some, model([c for *_, c in some])):
                for label, score, a, b in found:
                    value = c[a:b]
                    if label in labels and score >= least and len(value.strip()) >= length and value.lower() not in kept and not masked.search(value):
                        out[i].setdefault((o + a, o + b), ("ner", label, "ORG_NAME" if label == "ORG" else "PII", "MEDIUM" if label == "ORG" else "HIGH", o + a, o + b, value))
        return [list(f.values()) for f in out]

    return in_python(text, find)


def found_by(targets: DataFrame, pack: Rulepack, detectors: Sequence[str] = DETECTORS, model: Model | None = None) -> Column:
    """The findings of the targets' texts by all detectors, as an array."""
    if unknown := sorted(set(detectors) - set(DETECTORS)):
        raise ValueError(f"unknown detectors: {', '.join(unknown)}")
    text = F.col("content")
    zones = F.col("zones") if "zones" in targets.columns else None
    parts, free = [F.array().cast(FOUND)], []
    if "regex" in detectors:
        parts.append(regex_detector("content", pack, None if zones is None else "zones"))
    if "legal_id" in detectors:
        parts.append(legal_id_detector(text, zones))
    if "endpoint" in detectors:
        parts.append(endpoint_detector(text, pack, zones))
    if "ipv6" in detectors:
        free.append(ipv6_detector(text, pack.keep))
    if "dictionary" in detectors and pack.terms():
        free.append(dictionary_detector(text, pack.terms()))
    if "brand" in detectors and pack.terms() and "path" in targets.columns:
        parts.append(brand_detector(text, F.col("path"), pack.terms()))  # code has no other zones than its own
    if "ner" in detectors and model is not None:
        free.append(ner_detector(text, model, pack))
    return F.concat(*parts, *(f if zones is None else F.filter(f, lambda s: inside(s, zones)) for f in free))


def findings(targets: DataFrame, pack: Rulepack | None = None, detectors: Sequence[str] = DETECTORS, model: Model | None = None) -> DataFrame:
    """One row a finding: the target's scope, object_id and path, detector, rule, category, severity, line, offset_start,
    offset_end, matched_value, value_hash."""
    pack = pack or Rulepack()
    out = rows_of(targets.withColumn("_found", found_by(targets, pack, detectors, model)))
    if "path" in detectors and pack.terms() and {"scope", "path"} <= set(targets.columns):
        out = out.unionByName(path_findings(targets, pack).select(*out.columns) if "object_id" in targets.columns else path_findings(targets, pack).drop("object_id"))
    return out


def rows_of(targets: DataFrame) -> DataFrame:
    """The rows of ``findings`` of targets that carry the array of ``found_by`` as ``_found``."""
    text = F.col("content")
    keys = [c for c in ("scope", "object_id", "path") if c in targets.columns]
    # an outer explode: from an inner one Spark infers a filter on the array and pushes that through every projection below, so
    # all detectors run twice and, over a chain of rewrites, the expression doubles with each
    found = targets.select(*keys, "content", F.explode_outer("_found").alias("f")).where("f IS NOT NULL")
    f = F.col("f")
    return found.select(*keys, f["detector"].alias("detector"), f["rule"].alias("rule"), f["category"].alias("category"), f["severity"].alias("severity"), line_of(text, f["start"]).alias("line"), f["start"].alias("offset_start"), f["end"].alias("offset_end"), f["value"].alias("matched_value"), value_hash(f["value"]).alias("value_hash"))
