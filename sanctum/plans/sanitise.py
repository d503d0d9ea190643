"""Scan, sanitise, apply a brand map: plans of the operators.

A sanitise pass is one projection over the texts.  Passes repeat, over the texts in which the last one masked something, until
nothing that can be rewritten is left or the findings no longer change; each is a table in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, detect, rewrite
from ..rules import RULES, Rulepack


@dataclass
class Result:
    targets: DataFrame
    findings: DataFrame
    gates: DataFrame
    passes: int = 0


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and executors are threads of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sanctum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scan(targets: DataFrame, pack: Rulepack | None = None, detectors: Sequence[str] = detect.DETECTORS, strict: bool = False, model: detect.Model | None = None) -> Result:
    """Findings and gates; nothing is rewritten.  Entities are found by the model, if one is given."""
    found = detect.findings(targets, pack, detectors, model)
    ran = [d for d in detectors if d != "ner" or model is not None]
    return Result(targets, found, audit.finding_gates(found, strict, ran))


def sanitise_once(targets: DataFrame, salt: bytes, pack: Rulepack | None = None, model: detect.Model | None = None) -> DataFrame:
    """The targets with one round of findings masked."""
    # what is only ever reported isn't looked for
    finders = [d for d in detect.DETECTORS if d not in ("brand", "path")]
    with_found = targets.withColumn("_found", detect.found_by(targets, pack or Rulepack(), finders, model))
    return with_found.withColumn("content", rewrite.apply_findings(F.col("content"), F.col("_found"), salt)).drop("_found")


def fingerprint(findings: DataFrame) -> tuple[int, str]:
    """Count and digest of what can still be rewritten, whatever the order of rows."""
    row = findings.where(rewrite.rewritable("category")).select(F.xxhash64("object_id", "path", "value_hash").alias("h")).distinct().agg(F.count("*"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return row[0], row[1]


def written(df: DataFrame) -> DataFrame:
    """df, computed once into a table of the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/pass-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sanitise(targets: DataFrame, salt: bytes, pack: Rulepack | None = None, max_passes: int = 3, strict: bool = False, model: detect.Model | None = None) -> Result:
    """Rewrite until no finding is left, they no longer change, or max_passes are done.

    Each text is scanned once, and again only after a pass that had something to mask in it: findings stay with their texts, and
    a text without any that can be rewritten is what each further pass would make of it.
    """
    pack = pack or Rulepack()
    finders = [d for d in detect.DETECTORS if d not in ("brand", "path")]
    scanned = lambda df: df.withColumn("_found", detect.found_by(df, pack, finders, model))
    open_ = F.exists("_found", lambda f: rewrite.rewritable(f["category"]))
    active, seen, passes, pieces = written(scanned(targets)), None, 0, []
    for passes in range(1, max_passes + 1):
        pieces.append(active.where(~open_))
        masked = active.where(open_).withColumn("content", rewrite.apply_findings(F.col("content"), F.col("_found"), salt)).drop("_found")
        active = written(scanned(masked))
        now = fingerprint(detect.rows_of(active))
        if now[0] == 0 or now == seen:
            break
        seen = now
    done = active
    for piece in pieces:
        done = done.unionByName(piece)
    found = detect.rows_of(done.withColumn("_found", F.concat("_found", detect.found_by(done, pack, ("brand",)))))
    targets = done.select(*targets.columns)
    if pack.terms() and {"scope", "path"} <= set(targets.columns):
        found = found.unionByName(detect.findings(targets, pack, ("path",)).select(*found.columns))
    ran = [d for d in detect.DETECTORS if d != "ner" or model is not None]
    return Result(targets, found, audit.finding_gates(found, strict, ran), passes)


def scrub_targets(targets: DataFrame, salt: bytes, pack: Rulepack | None = None, harvest: DataFrame | None = None) -> DataFrame:
    """Whole texts scrubbed, as for histories.  harvest: findings whose secret values and persons are replaced wherever they
    occur, however many they are: they are a table in the shared folder that the tasks build their automaton from."""
    pack = pack or Rulepack()

    def literals(condition: str, secret: bool) -> DataFrame:
        return rewrite.safe_literals(harvest.where(condition).select(F.col("matched_value").alias("value")), secret=secret)

    if harvest is None:
        return rewrite.scrub(targets, "content", salt, pack.rules, pack.keep)
    folder = f"{shared_dir(targets.sparkSession)}/literals-{uuid.uuid4().hex}"
    literals("category = 'SECRET' AND length(matched_value) >= 5", True).write.parquet(f"{folder}/secrets")
    out = rewrite.replace_harvest(targets, "content", f"{folder}/secrets", salt, "REDACTED_")
    out = rewrite.scrub(out, "content", salt, pack.rules, pack.keep)
    if "detector" in harvest.columns:
        literals(f"detector = 'ner' AND category = 'PII' AND length(matched_value) >= {pack.policies.min_person_length}", False).write.parquet(f"{folder}/persons")
        out = rewrite.replace_harvest(out, "content", f"{folder}/persons", salt, "ANON_PER_")
    return out


def apply_map(targets: DataFrame, brands: Sequence[rewrite.Brand], max_report: int = 50) -> tuple[DataFrame, DataFrame]:
    """(targets with brands replaced in text and path, rows that still hold one)."""
    out = targets.withColumn("content", rewrite.apply_brand_map(F.col("content"), brands)).withColumn("path", rewrite.apply_brand_map(F.col("path"), brands))
    return out, rewrite.residual(out, "content", brands, max_report)


def secret_gate(targets: DataFrame) -> DataFrame:
    """Secrets that survived a rewrite."""
    return detect.findings(targets, Rulepack(rules=tuple(r for r in RULES if r.category == "SECRET")), ("regex",))


def main(argv: Sequence[str] | None = None) -> int:
    """``spark-submit`` entry: scan | sanitise | apply-map over a Parquet table with an id and a text column."""
    import argparse

    from ..sources.config import load_brand_map, load_rulepack, load_salt
    from ..sources.text import targets as table_targets

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("command", choices=["scan", "sanitise", "apply-map"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--id", default="doc_id")
    p.add_argument("--text", default="text")
    p.add_argument("--rules")
    p.add_argument("--map")
    p.add_argument("--waive", nargs="*", default=[], help="gates that needn't pass, e.g. ORG_NAME where no model runs")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    pack = load_rulepack(a.rules) if a.rules else Rulepack()
    rows = table_targets(spark.read.parquet(a.input), a.id, a.text, "table")
    if a.command == "apply-map":
        out, left = apply_map(rows, load_brand_map(a.map))
        out.write.parquet(f"{a.output}/texts")
        return int(left.limit(1).count() > 0)
    result = scan(rows, pack) if a.command == "scan" else sanitise(rows, load_salt(), pack)
    if a.command == "sanitise":
        result.targets.write.parquet(f"{a.output}/texts")
    audit.report(result.findings).write.parquet(f"{a.output}/findings")
    result.gates.write.json(f"{a.output}/gates")
    return int(not audit.all_passed(result.gates, a.waive).first()[0])


if __name__ == "__main__":
    raise SystemExit(main())
