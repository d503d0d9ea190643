"""Text of unknown encoding, corpora, and sinks."""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte-order marks in hexadecimal; the longer ones first.
MARKS = {"0000feff": "utf-32", "fffe0000": "utf-32", "efbbbf": "utf-8-sig", "feff": "utf-16", "fffe": "utf-16"}
DECODED = "struct<content:string,encoding:string>"


def decode_bytes(raw: bytes):
    """(text, encoding): by byte-order mark, else UTF-8, else cp1251, else UTF-8 with replacements."""
    head = raw[:4].hex()
    for name in [*[n for mark, n in MARKS.items() if head.startswith(mark)][:1], "utf-8", "cp1251"]:
        with contextlib.suppress(UnicodeDecodeError):
            return str(raw, name), name
    return str(raw, "utf-8", "replace"), "utf-8"


def decoded(data: Column) -> Column:
    """struct<content, encoding>; valid UTF-8 without a mark stays on the JVM side."""

    @F.pandas_udf(DECODED)
    def slow(raw: pd.Series) -> pd.DataFrame:
        pairs = [(None, None) if r is None else decode_bytes(bytes(r)) for r in raw]
        return pd.DataFrame(pairs, columns=["content", "encoding"])

    head = F.hex(F.substring(data, 1, 4))
    marked = head.rlike("^(EFBBBF|FFFE|FEFF|0000FEFF)")
    plain = F.is_valid_utf8(data.cast("string")) & ~marked
    quick = F.struct(data.cast("string").alias("content"), F.lit("utf-8").alias("encoding"))
    return F.when(data.isNull(), F.lit(None).cast(DECODED)).when(plain, quick).otherwise(slow(F.when(~plain, data)))


def encoded(text: Column, encoding: Column) -> Column:
    """The bytes of a text in its own encoding, signs it lacks replaced."""

    @F.pandas_udf("binary")
    def slow(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t.encode(n or "utf-8", errors="replace") for t, n in zip(texts, names)])

    plain = F.coalesce(encoding, F.lit("utf-8")) == "utf-8"
    return F.when(plain, F.encode(text, "UTF-8")).otherwise(slow(text, encoding))


def read_tree(spark: SparkSession, root: str, policies=None, pattern: str | None = None) -> DataFrame:
    """(path, size, content, encoding) of the files under a folder; ``.git`` is left out, and so are files that the
    policies don't scan, before their bytes are read."""
    from ..operators.inventory import decide

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    base = root.rstrip("/").removeprefix("file://")
    files = files.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "^" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base) + "/", "")).where(~F.col("path").rlike(r"(?:^|/)[.]git/"))
    if policies is not None:
        files = files.where(decide(F.col("path"), F.col("length"), policies)["action"] == "SCAN")
    return files.select("path", F.col("length").alias("size"), decoded(F.col("content")).alias("d")).select("path", "size", "d.content", "d.encoding")


def targets(df: DataFrame, id_col: str, text_col: str, scope: str, path: Column | None = None) -> DataFrame:
    """Scan targets of a table: (scope, object_id, path, content, zones), unrestricted."""
    return df.select(F.lit(scope).alias("scope"), F.col(id_col).cast("string").alias("object_id"), (path if path is not None else F.col(id_col).cast("string")).alias("path"), F.col(text_col).alias("content"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("zones"))


def unique_targets(df: DataFrame, text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(one row a distinct text with its digest, digests of all rows): scan once, join back by digest.  The first row of each
    digest is found by an aggregate over short rows; texts are shuffled only if the join with those can't be broadcast."""
    with_digest = df.withColumn("digest", F.sha2(F.encode(text_col, "UTF-8"), 256))
    return with_digest.groupBy("digest").agg(F.min("object_id").alias("object_id"), F.count("*").alias("copies")), with_digest.select("object_id", "digest")


def commits(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Scan targets of commit records, one a field; the bounds reach the scan."""
    from ..operators.batch import unpivot

    if since:
        df = df.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        df = df.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    out = unpivot(df, ["sha"], ["author_name", "author_email", "committer_name", "committer_email", "message"])
    return out.select(F.lit("metadata").alias("scope"), F.col("sha").alias("object_id"), F.concat(F.lit("<commit:"), F.substring("sha", 1, 8), F.lit("/"), F.col("field"), F.lit(">")).alias("path"), "content")


def blobs(df: DataFrame) -> DataFrame:
    """One row a blob, the path first in order."""
    from ..operators.batch import first_of

    return first_of(df, ["sha"], ["seq", "path"])


def distinct_paths(df: DataFrame) -> DataFrame:
    return df.select("path").distinct()


def write_reports(findings: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Findings by scope, without values, as JSON lines."""
    findings.drop("matched_value").write.mode(mode).partitionBy("scope").json(folder)


def digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of each row and one of the whole table that doesn't depend on the order of rows."""
    rows = df.withColumn("digest", F.sha2(F.encode(F.to_json(F.struct(*columns)), "UTF-8"), 256))
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.sum(F.conv(F.substring("digest", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").cast("binary"), 256).alias("digest"))
