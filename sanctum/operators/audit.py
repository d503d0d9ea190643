"""Summaries and gates over findings."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inventory import CONFIG_EXTS, ext_of
from .rewrite import ref_slug  # noqa: F401  (a gate and its remedy are used together)

#: name -> (description, test of a finding).  PII_HIGH asks for HIGH alone; PII_ALL is the stricter extension.
FINDING_GATES = {
    "SECRETS": ("no secrets", "category = 'SECRET'"),
    "PII_HIGH": ("no personal data of high severity", "category = 'PII' AND severity = 'HIGH'"),
    "DICTIONARY": ("no dictionary terms", "category = 'DICTIONARY'"),
    "ENDPOINTS": ("no endpoints", "category = 'ENDPOINT'"),
    "ORG_NAME": ("no organisations", "category = 'ORG_NAME'"),
    "BRAND_IDENTIFIER": ("no brands in identifiers", "category = 'BRAND_IDENTIFIER'"),
    "BRAND_PATH": ("no brands in paths", "category = 'BRAND_PATH'"),
    "PACKAGE_NAMESPACE": ("no brands in packages", "category = 'PACKAGE_NAMESPACE'"),
}
EXTENSIONS = {"PII_ALL": ("no personal data at all", "category = 'PII'")}
NON_BLOCKING = ("CLEAN_REF_NAMES",)
DELIVERY_GATES = ("SECRETS", "PII_HIGH", "DICTIONARY", "ENDPOINTS", "ORG_NAME", "FORBIDDEN_FILES", "CONFIGS")


#: Gate -> detector without which nothing is known of it; the others need ``regex``.
GATE_DETECTORS = {"DICTIONARY": "dictionary", "ENDPOINTS": "endpoint", "ORG_NAME": "ner", "BRAND_IDENTIFIER": "brand", "BRAND_PATH": "path", "PACKAGE_NAMESPACE": "brand"}


def finding_gates(findings: DataFrame, strict: bool = False, ran: Sequence[str] | None = None) -> DataFrame:
    """(gate, description, blocking, failing_count, passed) in one pass over the findings.

    ran: the detectors that ran, all by default.  A gate whose detector didn't run has null counts and isn't passed, unless
    something was found for it all the same.
    """
    gates = FINDING_GATES | (EXTENSIONS if strict else {})
    counts = findings.agg(*(F.count_if(F.coalesce(F.expr(test), F.lit(False))).alias(name) for name, (_, test) in gates.items()))
    rows = ", ".join(f"'{name}', '{text}', `{name}`" for name, (text, _) in gates.items())
    out = counts.selectExpr(f"stack({len(gates)}, {rows}) AS (gate, description, failing_count)")
    unknown = [g for g in gates if ran is not None and GATE_DETECTORS.get(g, "regex") not in ran]
    known = ~F.col("gate").isin(*unknown, "") | (F.col("failing_count") > 0)
    return out.select("gate", "description", F.lit(True).alias("blocking"), F.when(known, F.col("failing_count")).alias("failing_count"), (known & (F.col("failing_count") == 0)).alias("passed"))


def count_gate(name: str, description: str, failing: DataFrame) -> DataFrame:
    """A gate that fails on any row."""
    n = failing.agg(F.count("*").alias("failing_count"))
    return n.select(F.lit(name).alias("gate"), F.lit(description).alias("description"), F.lit(name not in NON_BLOCKING).alias("blocking"), "failing_count", (F.col("failing_count") == 0).alias("passed"))


def forbidden_files(inventory: DataFrame, output_paths: DataFrame) -> DataFrame:
    return output_paths.join(inventory.where("action = 'DELETE'").select("path"), "path", "left_semi")


def stray_configs(output_paths: DataFrame, allow_suffixes: Sequence[str]) -> DataFrame:
    allowed = F.lit(False)
    for s in allow_suffixes:
        allowed = allowed | F.endswith("path", F.lit(s))
    return output_paths.where(F.col("path").rlike(r"(?:^|/)(?:config[.][^/]*|[.]env(?:[.][^/]*)?)$") & ~allowed)


def config_valid(data: Column, path: Column) -> Column:
    """Whether a structured file parses: JSON, TOML, XML, and YAML (by its shape where no parser is installed); null for others."""

    @F.pandas_udf("boolean")
    def parse(texts: pd.Series, exts: pd.Series) -> pd.Series:
        return pd.Series([parses(t, e) for t, e in zip(texts, exts)], dtype="object")

    return parse(data, ext_of(path))


def parses(text: str | None, ext: str) -> bool | None:
    if text is None:
        return None
    try:
        if ext == "json":
            json.loads(text)
        elif ext == "toml":
            import tomllib

            tomllib.loads(text)
        elif ext in ("xml", "svg"):
            from xml.etree import ElementTree

            ElementTree.fromstring(text)
        elif ext in ("yaml", "yml"):
            try:
                import yaml
            except ImportError:
                return yaml_shape(text)
            list(yaml.safe_load_all(text))
        else:
            return None
    except Exception:  # any parser's error means that it isn't valid
        return False
    return True


def yaml_shape(text: str) -> bool:
    """Whether a text may be YAML, for want of a parser: no tab in an indent, quotes and brackets closed, and on lines that are
    neither in a block text nor in brackets a key, an item or a scalar of one line, indented as one of those around it.

    It finds what a rewrite breaks (quotes, brackets, indents), not every error.
    """
    import re

    line_of = re.compile(r"( *)(- +|-$)*(?:(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\"'\[\]{}&*!|>%@`,-][^#\n]*?|-[^\s#][^#\n]*?)\s*:(?=\s|$))?\s*(.*)$")
    open_, block, indents = [], None, [0]
    for line in text.split("\n"):
        line = line.rstrip()
        depth = len(line) - len(line.lstrip(" "))
        if not line.strip() or line.lstrip().startswith("#") or line in ("---", "...") or line.startswith("%"):
            continue
        if block is not None:
            if depth > block:
                continue
            block = None
        if line[depth] == "\t":
            return False
        value = line
        if not open_:
            m = line_of.match(line)
            while indents and depth < indents[-1]:
                indents.pop()
            if not indents or depth not in indents and depth > indents[-1]:
                indents.append(depth)
            elif depth != indents[-1]:
                return False
            value = m[4]
            if re.match(r"[|>][-+\d]*(?:\s+#.*)?$", value):
                block = depth
                continue
            if value[:1] in ("@", "`", "%") or m[3] is not None and re.match(r"[^\s\"'\[{&*!#][^\"'\[{]*:\s", value):
                return False
        quote, before = "", " "
        i = 0
        while i < len(value):
            c = value[i]
            if quote:
                if c == "\\" and quote == '"':
                    i += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'" and before in " [{,:(" and (i == 0 or open_ or not value[:i].strip()):
                quote = c
            elif c == "#" and before == " ":
                break
            elif c in "[{" and (open_ or not value[:i].strip()):
                open_.append("]" if c == "[" else "}")
            elif c in "]}" and open_:
                if open_.pop() != c:
                    return False
            before = c
            i += 1
        if quote:
            return False
    return not open_


def parse_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths valid before and invalid after; files that are gone are no regression."""
    b, a = before.select("path", F.col("valid").alias("was")), after.select("path", F.col("valid").alias("is"))
    return b.join(a, "path").where("was AND NOT `is`").select("path")


def clean_refs(refs: DataFrame, brands: Sequence[str], pattern: str) -> DataFrame:
    """Refs that hold a brand of three signs or more, or a match of the pattern."""
    hit = F.col("name").rlike(pattern)
    for b in brands:
        if len(b) >= 3:
            hit = hit | F.contains(F.lower("name"), F.lit(b.lower()))
    return refs.where(hit)


def branches_lost(intake: DataFrame, kept: DataFrame) -> DataFrame:
    """Intake branches without a slug among the kept ones."""
    return intake.join(kept.select("slug").distinct(), "slug", "left_anti")


def delivery_gates(inventory: DataFrame, output_paths: DataFrame, allow_suffixes: Sequence[str], configs_before: DataFrame, configs_after: DataFrame, refs: DataFrame, intake: DataFrame, kept: DataFrame, brands: Sequence[str] = (), pattern: str = r"@") -> DataFrame:
    """The gates on what is delivered besides its texts: (gate, description, blocking, failing_count, passed).

    inventory: (path, action); output_paths: (path); configs: (path, valid); refs: full names (name); intake, kept: (slug).
    """
    branches = refs.where("name LIKE 'refs/heads/%'").select(F.substring("name", F.lit(12), F.length("name")).alias("name"))
    parts = [
        count_gate("FORBIDDEN_FILES", "no forbidden files", forbidden_files(inventory, output_paths)),
        count_gate("CONFIGS", "no configuration but samples", stray_configs(output_paths, allow_suffixes)),
        count_gate("PARSEABLE_CONFIGS", "no structured file broken", parse_regressions(configs_before, configs_after)),
        count_gate("NO_TAGS", "no tags", refs.where("name LIKE 'refs/tags/%'")),
        count_gate("BRANCHES_PRESERVED", "no branch lost", branches_lost(intake, kept)),
        count_gate("CLEAN_REF_NAMES", "no brand or personal data in branch names", clean_refs(branches, brands, pattern)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_passed(gates: DataFrame, waive: Sequence[str] = ()) -> DataFrame:
    """Whether all blocking gates passed, but for those waived."""
    gates = gates.where(~F.col("gate").isin(*waive, ""))
    return gates.agg(F.coalesce(F.bool_and(F.when(F.col("blocking"), F.col("passed"))), F.lit(True)).alias("passed"))


def blocking_failures(gates: DataFrame, wanted: Sequence[str] = DELIVERY_GATES) -> DataFrame:
    """Delivery gates that failed or are missing: what isn't known to pass doesn't."""
    spark = gates.sparkSession
    return spark.createDataFrame([(g,) for g in wanted], "gate string").join(gates.select("gate", "passed"), "gate", "left").where("passed IS NULL OR NOT passed").select("gate")


def category_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    return findings.rollup("scope", "category", "severity").agg(F.count("*").alias("n"))


def extension_histogram(items: DataFrame, limit: int = 20) -> DataFrame:
    return items.groupBy(ext_of(F.col("path")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(limit)


def report(findings: DataFrame) -> DataFrame:
    """Findings fit for a report: without the values."""
    return findings.drop("matched_value")


CONFIG_LIKE = CONFIG_EXTS
