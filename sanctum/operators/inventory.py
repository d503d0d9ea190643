"""Classification of files and what is done with them."""

from __future__ import annotations

import fnmatch
import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import Policies
from .zones import LANGUAGE

DOCS = "adoc csv md pdf rst tex txt".split()
CONFIG_NAMES = "dockerfile jenkinsfile makefile procfile vagrantfile".split()
CONFIG_EXTS = "cfg conf ini json properties toml xml yaml yml".split()


def ext_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[.]([^./]+)$", 1))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def glob(pattern: str) -> str:
    """A Java expression for a shell pattern, in which * crosses slashes."""
    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(")\\Z") + "$"


def mime_of(path: Column) -> Column:
    ext, out = ext_of(path), F.lit("application/octet-stream")
    by_mime: dict[str, list[str]] = {}
    for e, m in mimetypes.types_map.items():
        by_mime.setdefault(m.split("/")[0], []).append(e[1:])
    for kind in ("text", "image", "audio", "video"):
        out = F.when(ext.isin(*sorted(by_mime.get(kind, []))), F.lit(f"{kind}/*")).otherwise(out)
    return out


def classify(path: Column) -> Column:
    """code, config, docs or binary."""
    ext, mime = ext_of(path), mime_of(path)
    code = sorted(set(LANGUAGE) - set(CONFIG_EXTS) - {"dockerfile", "mk"})
    return (
        F.when(ext.isin(*code), "code")
        .when(ext.isin(*DOCS), "docs")
        .when(ext.isin(*CONFIG_EXTS) | F.lower(name_of(path)).isin(*CONFIG_NAMES), "config")
        .when(mime == "text/*", "docs")
        .when(mime.isin("image/*", "audio/*", "video/*"), "binary")
        .when(ext.isin("bin", "dat", "o", "obj"), "binary")
        .otherwise("docs")
    )


def decide(path: Column, size: Column, policies: Policies = Policies()) -> Column:
    """struct<action, reason>; the first that holds: allowed suffix, denied name, denied type, binary, size."""
    p = policies
    result = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    allowed = _any(F.endswith(path, F.lit(s)) for s in p.allow_suffixes)
    stem = F.regexp_replace(name_of(path), r"[.][^.]+$", "")
    denied = _any(path.rlike(glob(g)) | name_of(path).rlike(glob(g)) | stem.rlike(glob(g)) for g in p.deny_globs)
    big = size > int(p.max_file_mb * 2**20)
    return (
        F.when(allowed, F.when(big, result("SKIP", "size")).otherwise(result("SCAN", "allow_suffix")))
        .when(denied, result("DELETE", "deny_glob"))
        .when(ext_of(path).isin(*p.binary_deny), result("DELETE", "denied_type"))
        .when((classify(path) == "binary") | ext_of(path).isin(*p.binary_allow), result("SKIP", "binary"))
        .when(big, result("SKIP", "size"))
        .otherwise(result("SCAN", ""))
    )


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def removed_from_history(path: Column, policies: Policies = Policies()) -> Column:
    """Denied by name or type; an allowed suffix wins."""
    allowed = _any(F.endswith(path, F.lit(s)) for s in policies.allow_suffixes)
    denied = _any(name_of(path).rlike(glob(g.rpartition("/")[2])) for g in policies.deny_globs)
    return ~allowed & (denied | ext_of(path).isin(*policies.binary_deny))


def is_binary(data: Column) -> Column:
    """A NUL in the first 8 KB."""
    return F.instr(F.decode(F.substring(data, 1, 8192), "ISO-8859-1"), "\0") > 0


def inventory(files: DataFrame, policies: Policies = Policies(), path_col: str = "path", size_col: str = "size") -> DataFrame:
    """(path, size, mime, category, action, reason)."""
    path = F.col(path_col)
    out = files.select(path.alias("path"), F.col(size_col).alias("size"), mime_of(path).alias("mime"), classify(path).alias("category"), decide(path, F.col(size_col), policies).alias("d"))
    return out.select("path", "size", "mime", "category", "d.action", "d.reason")


def action_counts(items: DataFrame) -> DataFrame:
    return items.agg(*(F.count_if(F.col("action") == a).alias(a.lower()) for a in ("SCAN", "DELETE", "SKIP")))
