"""Batches: tasks, their state, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derive_key(source: Column) -> Column:
    """A key for a source: its last part without ``.git``, reduced to safe signs."""
    last = F.regexp_extract(F.regexp_replace(source, r"[/\s]+$", ""), r"([^/:]*)$", 1)
    return F.regexp_replace(F.regexp_replace(last, r"[.](git|bundle)$", ""), r"[^\w.-]+", "-")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; an aggregate with a map-side step, so a hot key is folded before it is shuffled."""
    value = F.struct(*[F.col(c) for c in df.columns])
    sort = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(value, sort).alias("_v")).select("_v.*")


def pending(tasks: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """Tasks without a finished run."""
    return tasks.join(state.where("status IN ('done', 'failed')").select(key).distinct(), key, "left_anti")


def retry(tasks: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """Tasks that aren't done, failed ones among them."""
    return tasks.join(state.where("status = 'done'").select(key).distinct(), key, "left_anti")


def summary(tasks: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    latest = first_of(state, [key], [F.col(key)])
    joined = tasks.join(latest.select(key, "status"), key, "left")
    count = lambda s: F.count_if(F.col("status") == s)
    return joined.agg(F.count("*").alias("total"), count("done").alias("done"), count("failed").alias("failed"), F.count_if(F.coalesce(~F.col("status").isin("done", "failed"), F.lit(True))).alias("pending"))


def in_scope(projects: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    return projects.join(scope.select(key).distinct(), key, "left_semi")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(seq, value): lines stripped, comments and blanks left out, the first of equal ones, in order."""
    kept = lines.select("seq", F.trim("value").alias("value")).where("value <> '' AND NOT startswith(value, '#')")
    return kept.groupBy("value").agg(F.min("seq").alias("seq")).select("seq", "value").orderBy("seq")


def unpivot(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A scan target for each field of each row: (keys, field, content)."""
    rows = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in fields)
    return df.selectExpr(*keys, f"stack({len(fields)}, {rows}) AS (field, content)").where("content IS NOT NULL")


def numbered(df: DataFrame, base: str, order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(base).orderBy(order)))
