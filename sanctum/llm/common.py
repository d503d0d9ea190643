"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch, unless the session says otherwise: texts are long, and a batch is held by both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "1024")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``; one of our own only where it is unset and
    executors are threads of this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="sanctum-")
        spark.conf.set("spark.checkpoint.dir", d)
    # with its scheme, so that Python workers open the same place as Spark
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


#: Folders written by this session, oldest first.
WRITTEN: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that no result still to be computed reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        WRITTEN.remove(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, a lost executor costs nothing
    that was written, and the reader knows the size, so that Spark broadcasts it only below its threshold."""
    bound_batches(df.sparkSession)
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of at most ``rows`` rows, to bound what a Python worker holds at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` with small batches in and out."""
    bound_batches(df.sparkSession)

    def run(batches):
        for b in slices(batches, rows):
            out = make(b)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


# == joins on keys that many rows share ==

HOT = 1000


def by_key(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key once and, in ``count``, how many rows have it.

    Keys with over a thousandth of the counted rows, so fewer than HOT of them, are broadcast; no hot key is shuffled.  Both
    sides are read twice, so they should be written tables of short rows.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot, cold = table.where(F.col(count) * HOT > total), table.where(F.col(count) * HOT <= total)
    hot_rows = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return hot_rows.unionByName(rest)


def small_table(spark: SparkSession, rows: list, schema: str, limit: int = 8 << 20) -> DataFrame:
    """A table of the driver's rows: broadcast if their text is below ``limit`` bytes, else written and joined as Spark sees fit."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if sum(len(str(tuple(r))) for r in rows) <= limit else materialize(df, "small")


# == decisions on rows by their position ==
#
# A decision on documents made from short rows (a fingerprint, a size) has to find its way back to the texts.  A join would
# shuffle them.  Rows of Parquet files have a position instead, the file and the row in it; decisions are written in the order
# of positions, and each task that scans texts reads those of its own files.  No text is shuffled and nothing is broadcast.

MAX_BUCKETS = 1 << 16


def positioned(docs: DataFrame) -> DataFrame:
    """docs with __file (a hash of the file's path) and __row; a table that isn't read from files is written first."""
    position = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        return docs.select("*", *position)
    except AnalysisException:
        return materialize(docs, "positioned").select("*", *position)


def row_id(docs: DataFrame, id_col: str) -> DataFrame:
    """Positioned docs with __id: the id and, to tell rows of one id apart, the position."""
    return docs.withColumn("__id", F.struct(F.col(id_col).alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row")))


class Decisions:
    """Decisions (file, row, ...) written by position, read by the tasks that scan the rows."""

    def __init__(self, decisions: DataFrame, docs: DataFrame):
        """docs: the positioned rows, whose files give the number of buckets."""
        self.path, self.buckets = new_path(docs.sparkSession, "decisions"), min(MAX_BUCKETS, max(16, len(docs.inputFiles())))
        self.columns = [c for c in decisions.columns if c not in ("file", "row")]
        self.file, self.open = None, None
        placed = decisions.withColumn("b", F.pmod("file", F.lit(self.buckets)))
        placed.repartition("b").sortWithinPartitions("b", "file", "row").write.partitionBy("b").parquet(self.path)

    def _load(self, file: int) -> None:
        if self.open is None:
            self.open = open_fs(self.path)
        fs, root = self.open
        folder = f"{root}/b={file % self.buckets}"
        self.file, self.rows, self.table = file, np.zeros(0, np.int64), None
        if fs.get_file_info(folder).type != pa.fs.FileType.NotFound:
            t = pa.dataset.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["row", *self.columns], filter=pa.dataset.field("file") == file)
            order = np.argsort(t["row"].to_numpy(), kind="stable")
            self.table = t.take(pa.array(order)).combine_chunks()
            self.rows = self.table["row"].to_numpy()

    def runs(self, files: np.ndarray, position: np.ndarray):
        """For each run of rows of one file: (from, to, place in the table of the file's decisions, or -1 for none)."""
        cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if files[i] != self.file:
                self._load(int(files[i]))
            if not len(self.rows):
                yield i, j, np.full(j - i, -1)
                continue
            found = np.minimum(np.searchsorted(self.rows, position[i:j]), len(self.rows) - 1)
            yield i, j, np.where(self.rows[found] == position[i:j], found, -1)


def by_position(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """From positioned docs, rows as often as (file, row, copies) says; rows without a decision go.  The columns but for the
    position stay as they are."""
    decided = Decisions(decisions.select("file", "row", F.col("copies").cast("int").alias("copies")), docs)
    kept = docs.drop("__file", "__row", "__id")
    at_file, at_row = docs.columns.index("__file"), docs.columns.index("__row")
    at = [docs.columns.index(c) for c in kept.columns]

    def run(batches):
        for b in slices(batches, 1024):
            files, position = (b.column(i).to_numpy(zero_copy_only=False) for i in (at_file, at_row))
            for i, j, found in decided.runs(files, position):
                if (found >= 0).any():
                    n = np.where(found >= 0, decided.table["copies"].to_numpy()[found], 0)
                    yield b.select(at).take(pa.array(np.repeat(np.arange(i, j), n)))

    return docs.mapInArrow(run, kept.schema)
