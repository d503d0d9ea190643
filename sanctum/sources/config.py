"""Loaders of rulepacks, brand maps, lists and batch settings; what is wrong is an error when it is loaded."""

from __future__ import annotations

import csv
import json
import os
import re
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.rewrite import Brand
from ..rules import CATEGORIES, RULES, SEVERITIES, Policies, Rule, Rulepack


def load_terms(path: str | Path) -> tuple[str, ...]:
    lines = (x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
    return tuple(x for x in lines if x and not x.startswith("#"))


def _load(path: Path):
    if path.suffix == ".json":
        return json.loads(path.read_text(encoding="utf-8"))
    import yaml

    with path.open("rb") as f:
        return yaml.safe_load(f)


def load_rulepack(folder: str | Path) -> Rulepack:
    """A folder with VERSION, rules, policies and extractors as .json or .yaml, and dict/*.txt."""
    folder = Path(folder)
    if not (folder / "VERSION").exists():
        raise FileNotFoundError(f"{folder} has no VERSION")
    find = lambda name: next((folder / f"{name}{s}" for s in (".json", ".yaml", ".yml") if (folder / f"{name}{s}").exists()), None)
    pack = Rulepack(version=(folder / "VERSION").read_text().strip())
    if p := find("rules"):
        pack = replace(pack, rules=tuple(make_rule(r) for r in _load(p)["rules"]))
    if p := find("policies"):
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in _load(p).items() if k in Policies.__dataclass_fields__}
        pack = replace(pack, policies=Policies(**known))
    if p := find("extractors"):
        languages = {}
        for entry in _load(p)["languages"]:
            if not entry.get("grammar_package"):
                raise ValueError(f"language {entry.get('id')} has no grammar_package")
            languages[entry["id"]] = tuple(entry.get("file_extensions", ()))
        pack = replace(pack, languages=languages)
    return replace(pack, dictionaries={f.stem: load_terms(f) for f in sorted((folder / "dict").glob("*.txt"))})


def make_rule(entry: dict) -> Rule:
    """A rule of a mapping; an unknown category counts as PII, an unknown severity as HIGH."""
    known = {r.name: r for r in RULES}
    category, severity = str(entry.get("category", "")).upper(), str(entry.get("severity", "")).upper()
    base = known.get(entry["name"], Rule(entry["name"], entry["pattern"]))
    re.compile(re.sub(r"\\p\{\w+\}", "x", entry["pattern"]))
    guard = base.guard if base.pattern == entry["pattern"] else tuple(entry.get("guard", ()))
    return replace(base, pattern=entry["pattern"], category=category if category in CATEGORIES else "PII", severity=severity if severity in SEVERITIES else "HIGH", guard=guard)


def load_salt(name: str = "SANCTUM_SALT") -> bytes:
    """The salt, from the environment alone."""
    salt = os.environ.get(name, "")
    if not salt:
        raise ValueError(f"{name} isn't set")
    return salt.encode()


def load_brand_map(path: str | Path) -> list[Brand]:
    """Rows of a CSV, or of JSON: a list, or a mapping with ``rules`` or ``map``."""
    path = Path(path)
    if path.suffix == ".csv":
        with path.open(encoding="utf-8", newline="") as f:
            rows = list(csv.DictReader(f))
    else:
        rows = json.loads(path.read_text(encoding="utf-8"))
        if isinstance(rows, dict):
            rows = rows.get("rules", rows.get("map"))
        if not isinstance(rows, list):
            raise ValueError("a brand map is a list of rows")
    return [make_brand(r) for r in rows if r.get("pattern")]


def make_brand(row: dict) -> Brand:
    flag = lambda v, default: default if v in (None, "") else v if isinstance(v, bool) else str(v).strip().lower() in {"y", "yes", "true", "1"}
    is_regex = flag(row.get("is_regex"), True)
    if is_regex:
        try:
            re.compile(row["pattern"])
        except re.error as e:
            raise ValueError(f"pattern {row['pattern']!r}: {e}") from e
    priority = row.get("priority")
    return Brand(row["pattern"], row.get("replacement") or "", is_regex, flag(row.get("preserve_case"), False), 100 if priority in (None, "") else int(priority))


def brand_frame(spark: SparkSession, brands: list[Brand]) -> DataFrame:
    rows = [(b.pattern, b.replacement, b.is_regex, b.preserve_case, b.priority) for b in brands]
    return spark.createDataFrame(rows, "pattern string, replacement string, is_regex boolean, preserve_case boolean, priority int")


def load_list(path: str | Path) -> list[str]:
    """Lines without comments and blanks, the first of equal ones; an empty list is an error."""
    out = list(dict.fromkeys(load_terms(path)))
    if not out:
        raise ValueError(f"{path} lists nothing")
    return out


def load_batch(path: str | Path) -> dict:
    """Settings of a batch over defaults; ``url`` must be a host alone."""
    given = _load(Path(path))
    missing = [k for k in ("url", "output") if not given.get(k)]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    if not re.fullmatch(r"https?://[^/?#@]+/?", given["url"]):
        raise ValueError("url must be a host without a path")
    return {"workers": 8, "model_batch": 32, "scope": "off", "retry_failed": False} | given
