r"""Exact top-k search by inner product: columnar branch and bound.

Components are floor(scale * x) as integers.  Candidates are kept vertically, a row for each dimension.  For a block of
queries the inner products are summed dimension block by dimension block, strongest first.  After each block a candidate
is dropped for a query if its sum plus the bound on what is left (the norms of the remaining parts, by Cauchy-Schwarz)
stays below the query's k-th best score so far; columns that no query of the block wants are compacted away.

Queries are a table in the shared folder that every task reads block by block: nothing is broadcast, whatever their
number.  A task holds its own candidates and takes each block of queries through all of them, so thresholds carry from one
block of candidates to the next and at most k rows a query leave the task (or each HELD_BYTES of a larger task's vectors).

Edge cases: vectors that are null, or hold null, NaN or infinite components, take no part; shorter vectors count as
padded with zeros; products that doubles don't hold exactly are taken in Python integers, and
a score of the result that doesn't fit 64 bits raises OverflowError; of equal scores the smaller id is first; rows with a repeated id are candidates of their own, though a
query never finds rows of its own id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, open_fs, read_table

QUERY_BLOCK, CANDIDATES, DIMS = 64, 16_384, 8
#: Candidates that a task holds, as integers, while it goes through the queries.
HELD_BYTES = 256 << 20
EXACT = float(2**53)


def scaled(ids: pa.Array, vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer vectors as rows) of those that take part, padded to the longest."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    length = np.diff(vectors.offsets.to_numpy()) * valid
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    bad = ~np.isfinite(x)
    row = np.repeat(np.arange(len(length)), length)
    ok = valid & (np.bincount(row[bad], minlength=len(length)) == 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(length), int(length.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = np.where(bad, 0, np.floor(scale * np.where(bad, 0, x)))
    return ids.filter(pa.array(ok)).to_numpy(zero_copy_only=False).astype(np.int64), out[ok]


def _pad(a: np.ndarray, d: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, d - a.shape[1]))) if a.shape[1] < d else a


class Block:
    """A block of queries and the k best candidates that each has met so far."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q, k
        self.at, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.threshold = np.full(len(qid), -np.inf)

    def _keep(self, at, found, scores) -> None:
        at, found, scores = (np.concatenate(x) for x in ((self.at, at), (self.found, found), (self.scores, scores)))
        rank = np.lexsort((found, -scores, at))
        at, found, scores = at[rank], found[rank], scores[rank]
        keep = np.arange(len(at)) - np.searchsorted(at, at, side="left") < self.k
        self.at, self.found, self.scores = at[keep], found[keep], scores[keep]
        n = np.bincount(self.at, minlength=len(self.qid))
        last = np.cumsum(n) - 1
        full = n == self.k
        self.threshold[full] = self.scores[last[full]]

    def search(self, cid: np.ndarray, c: np.ndarray) -> None:
        """Meet more candidates."""
        d = max(self.q.shape[1], c.shape[1])
        q, c = _pad(self.q, d), _pad(c.astype(np.float64), d)
        if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(d, 1) >= EXACT:
            self._search_large(q, cid, c)
            return
        order = np.argsort(-(q * q).sum(axis=0), kind="stable")
        q, v = q[:, order], np.ascontiguousarray(c[:, order].T)
        # remaining norms after each block of dimensions
        cuts = list(range(0, d, DIMS)) + [d]
        q_left = np.sqrt(np.stack([(q[:, a:] ** 2).sum(axis=1) for a in cuts], axis=1)) if d else np.zeros((len(q), 1))
        c_left = np.sqrt(np.stack([(v[a:] ** 2).sum(axis=0) for a in cuts])) if d else np.zeros((1, len(cid)))
        at, step = 0, max(self.k + 1, min(1024, len(cid))) if np.isinf(self.threshold).any() else len(cid)
        while at < len(cid):  # without thresholds a small piece first sets them for the rest
            columns = np.arange(at, min(len(cid), at + step))
            at, step = at + step, len(cid)
            part = np.zeros((len(q), len(columns)))
            for b in range(len(cuts) - 1):
                part += q[:, cuts[b] : cuts[b + 1]] @ v[cuts[b] : cuts[b + 1], columns]
                bound = part + q_left[:, b + 1 : b + 2] * c_left[b + 1, columns][None, :] * (1 + 1e-12) + 1e-6
                wanted = (bound >= self.threshold[:, None]).any(axis=0)
                if wanted.mean() < 0.75:
                    columns, part = columns[wanted], part[:, wanted]
                if not len(columns):
                    break
            alive = (part >= self.threshold[:, None]) & (cid[columns][None, :] != self.qid[:, None])
            if alive.shape[1] > self.k:
                # those below each query's own k-th best here are no use to it
                some = np.where(alive, part, -np.inf)
                alive &= part >= np.partition(some, alive.shape[1] - self.k, axis=1)[:, alive.shape[1] - self.k][:, None]
            row, column = np.nonzero(alive)
            self._keep(row, cid[columns[column]], np.rint(part[row, column]).astype(np.int64))

    def _search_large(self, q, cid, c) -> None:
        """Beyond what doubles hold exactly: no pruning, Python integers."""
        scores = q.astype(object) @ c.T.astype(object) if q.shape[1] else np.zeros((len(q), len(cid)), object)
        for i in range(len(q)):
            order = sorted((j for j in range(len(cid)) if cid[j] != self.qid[i]), key=lambda j: (-scores[i, j], cid[j]))[: self.k]
            if any(abs(int(scores[i, j])) >= 1 << 63 for j in order):
                raise OverflowError("a score doesn't fit 64 bits: choose a smaller scale")
            self._keep(np.full(len(order), i), cid[order].astype(np.int64), np.array([int(scores[i, j]) for j in order], np.int64))

    def best(self) -> list[np.ndarray]:
        """(query, candidate id, score), at most k of a query."""
        return [self.qid[self.at], self.found, self.scores]


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    """The k best candidates of each query: arrays (query, candidate id, score)."""
    block = Block(qid, q, k)
    block.search(cid, c)
    return block.best()


def _blocks(batches, scale: float):
    """Candidates in blocks of CANDIDATES, as integers of 16, 32 or 64 bits where they fit, else as doubles."""
    held, n = [], 0

    def block():
        width = max(c.shape[1] for _, c in held)
        ids, c = np.concatenate([i for i, _ in held]), np.concatenate([_pad(c, width) for _, c in held])
        most = np.abs(c).max(initial=0)
        small = next((t for t, top in ((np.int16, 2**15), (np.int32, 2**31), (np.int64, 2**63)) if most < top), np.float64)
        return ids, c.astype(small)

    for b in batches:
        ids, c = scaled(b.column(0), b.column(1), scale)
        if len(ids):
            held.append((ids, c))
            n += len(ids)
        if n >= CANDIDATES:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def _query_blocks(path: str, rows: int):
    import pyarrow.dataset as ds

    fs, root = open_fs(path)
    # batches of a dataset are read one by one
    for batch in ds.dataset(root, filesystem=fs, format="parquet").to_batches(batch_size=rows, columns=["id", "v"], batch_readahead=1, fragment_readahead=1):
        if batch.num_rows:
            yield batch


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of queries against all rows of vectors but those of its id."""
    spark = vectors.sparkSession
    path = new_path(spark, "queries")
    queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).write.parquet(path)

    def run(batches):
        held, size = [], 0

        def answer():
            for b in _query_blocks(path, QUERY_BLOCK):
                qid, q = scaled(b.column(0), b.column(1), scale)
                if len(qid):
                    block = Block(qid, q, k)
                    for cid, c in held:
                        block.search(cid, c)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.best()], names=["query_id", "vec_id", "score"])

        for b in _blocks(batches, scale):
            held.append(b)
            size += b[1].nbytes
            if size >= HELD_BYTES:
                yield from answer()
                held, size = [], 0
        if held:
            yield from answer()

    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
