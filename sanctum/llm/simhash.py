"""Near duplicates by SimHash, compared in bit-sliced form.

Fingerprints are found exactly within ``radius`` bits of each other in three steps:

1. Equal fingerprints are folded to one row with a count first, so a group of copies, however large, is one row from
   there on.
2. Pigeonhole keys.  The 64 bits are cut into ``radius + k`` blocks; two fingerprints at most ``radius`` bits apart
   agree in at least ``k`` of them.  One table for each choice of ``k`` blocks brings all such pairs together.  A pair
   counts only in the first of its tables, so nothing is counted twice and no pair is ever written out.
3. In a table's group the comparison is bit-sliced: bit planes are stored vertically, 64 candidates to a machine word;
   a two-bit carry-save counter with an overflow plane holds 64 distances at once; candidate words in which all
   distances are beyond the radius are abandoned.

Groups above ``max_group`` are cut into chunks, and each pair of chunks is its own group, so no task holds an unbounded
one and all pairs are still compared.  Links leave a group as a count and an edge to a group-local root: as many rows as
members.

Edge cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; repeated
rows are documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, id_type, map_rows, materialize, read_table, utf8

MAX_GROUP = 4096
SMALL = 48
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of the word shingles of UTF-8 text."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - width + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit integer."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, width, seed) for t in utf8(b.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, make, f"doc_id {id_type(source, 'doc_id')}, fp long")


# == bit-sliced comparison ==


def planes_of(fp: np.ndarray) -> np.ndarray:
    """64 bit planes over n fingerprints: plane b holds bit b of 64 fingerprints to a word."""
    n = len(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((64, -(-n // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _close_lanes(bit_of, n_words: int, lead: int, order: list[list[int]], early: list[list[int]], radius: int):
    """Lanes whose distance is at most radius and that differ in each block of ``early``.

    bit_of(plane, words) gives the difference plane over the kept words, of shape (lead, len(words)).  order: the planes
    by block.  Returns (words, mask): the words not abandoned and their lane masks.
    """
    words = np.arange(n_words)
    low = np.zeros((lead, n_words), np.uint64)
    high, over = low.copy(), low.copy()
    differs: list[np.ndarray] = []
    for k, block in enumerate(order):
        seen = np.zeros((lead, len(words)), np.uint64) if k < len(early) else None
        for plane in block:
            x = bit_of(plane, words)
            if seen is not None:
                seen |= x
            carry = low & x
            low ^= x
            over |= high & carry
            high ^= carry
        if radius == 3:
            dead = over
        elif radius == 2:
            dead = over | (high & low)
        elif radius == 1:
            dead = over | high
        else:
            dead = over | high | low
        if seen is not None:
            differs.append(seen)
        alive = (dead != FULL).any(axis=0)
        if not alive.all():
            words, low, high, over = words[alive], low[:, alive], high[:, alive], over[:, alive]
            differs = [d[:, alive] for d in differs]
            if not len(words):
                break
    mask = ~(over | (high & low if radius == 2 else high if radius == 1 else (high | low) if radius == 0 else np.uint64(0)))
    for d in differs:
        mask &= d
    return words, mask


def _lanes(mask: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Lane masks as a boolean matrix over all n lanes."""
    out = np.zeros((mask.shape[0], -(-n // 64), 64), bool)
    if len(words):
        out[:, words] = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8), axis=1, bitorder="little").reshape(mask.shape[0], len(words), 64)
    return out.reshape(mask.shape[0], -1)[:, :n]


def _blocks(n: int) -> list[list[int]]:
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def table_masks(n_blocks: int, radius: int) -> list[tuple[int, list[list[int]], list[list[int]]]]:
    """For each table: the mask of its key bits, the blocks before its last one that must differ for a pair to be its
    own, and the remaining blocks to compare, those first."""
    blocks = _blocks(n_blocks)
    out = []
    for chosen in combinations(range(n_blocks), n_blocks - radius):
        early = [blocks[b] for b in range(chosen[-1]) if b not in chosen]
        late = [blocks[b] for b in range(chosen[-1], n_blocks) if b not in chosen]
        out.append((sum(1 << p for b in chosen for p in blocks[b]), early, early + late))
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _small_groups(fp, weight, start, size, early, order, radius):
    """All groups of at most SMALL members together: the pairs at each distance in rank are the lanes."""
    n = len(fp)
    pos = np.arange(n) - np.repeat(start, size)
    room = np.repeat(size, size) - pos
    add, pa_, pb_ = np.zeros(n, np.int64), [], []
    for d in range(1, int(size.max(initial=1))):
        for i0 in range(0, n, 1 << 17):
            i = i0 + np.flatnonzero(room[i0 : i0 + (1 << 17)] > d)
            if not len(i):
                continue
            planes = planes_of(fp[i] ^ fp[i + d])
            words, mask = _close_lanes(lambda p, w, planes=planes: planes[p, w][None, :], planes.shape[1], 1, order, early, radius)
            hit = i[_lanes(mask, words, len(i))[0]]
            np.add.at(add, hit, weight[hit + d])
            np.add.at(add, hit + d, weight[hit])
            pa_.append(hit)
            pb_.append(hit + d)
    root = _roots(n, np.concatenate(pa_), np.concatenate(pb_)) if pa_ else np.arange(n)
    return add, root


def _large_group(fp, weight, side, early, order, radius, step: int = 64):
    """One group: a block of queries against the vertical planes of all members."""
    n = len(fp)
    planes = planes_of(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").astype(bool)
    two = bool(side[0])
    add, root = np.zeros(n, np.int64), np.arange(n)
    w = weight.astype(np.float64)
    for q0 in range(0, n, step):
        q = np.arange(q0, min(n, q0 + step))
        flip = np.where(bits[q], FULL, np.uint64(0))
        words, mask = _close_lanes(lambda p, ws: planes[p, ws][None, :] ^ flip[:, p][:, None], planes.shape[1], len(q), order, early, radius)
        near = _lanes(mask, words, n)
        near[np.arange(len(q)), q] = False
        if two:
            near &= side[None, :] != side[q][:, None]
        add[q] = np.rint(near @ w).astype(np.int64)
        for k in np.flatnonzero(near.any(axis=1)):
            labels = np.unique(np.append(root[near[k]], root[q[k]]))
            if len(labels) > 1:
                root[np.isin(root, labels[1:])] = labels[0]
    return add, root


def link_sorted(t, key, part, fp, weight, side, masks, radius):
    """Links among rows sorted by (t, key, part): arrays (fp, add, root) of the rows that have any.

    side: 0 in a part that is one chunk; 1 and 2 in a part of two chunks, of which only pairs across count.
    """
    change = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(part) != 0)) + 1
    start = np.concatenate([[0], change])
    size = np.diff(np.append(start, len(fp)))
    out = []

    def take(rows, add, root):
        has = add > 0
        # the root of a component has links itself, so it is among the rows
        out.append((fp[rows][has], add[has], fp[rows][root[has]]))

    tables = t[start]
    for table in np.unique(tables):
        _, early, order = masks[table]
        own = tables == table
        small = own & (size > 1) & (size <= SMALL) & (np.maximum.reduceat(side, start) == 0)
        if small.any():
            s = size[small]
            rows = np.repeat(start[small], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            take(rows, *_small_groups(fp[rows], weight[rows], np.cumsum(s) - s, s, early, order, radius))
        for g in np.flatnonzero(own & (size > 1) & ~small):
            rows = np.arange(start[g], start[g] + size[g])
            take(rows, *_large_group(fp[rows], weight[rows], side[rows], early, order, radius))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def _linker(masks, radius):
    """Streams sorted rows; only the group that is still open is carried from batch to batch."""
    names = ["t", "key", "part", "fp", "w", "side"]

    def emit(a):
        found = link_sorted(a["t"], a["key"], a["part"], a["fp"].view(np.uint64), a["w"], a["side"], masks, radius)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1]), pa.array(found[2].view(np.int64))], names=["fp", "near", "root"])

    def run(batches):
        held: list[dict] = []
        for b in batches:
            if not b.num_rows:
                continue
            a = {k: b.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            last = len(a["t"]) - 1
            cut = np.flatnonzero((a["t"] != a["t"][last]) | (a["key"] != a["key"][last]) | (a["part"] != a["part"][last]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            same = held and all(held[-1][k][-1] == a[k][0] for k in ("t", "key", "part"))
            if not same or cut:
                ready = held + ([{k: v[:cut] for k, v in a.items()}] if cut else [])
                if ready:
                    yield from emit({k: np.concatenate([h[k] for h in ready]) for k in names})
                held = []
            held.append({k: v[cut:] for k, v in a.items()})
        if held:
            yield from emit({k: np.concatenate([h[k] for h in held]) for k in names})

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of edges (u, v), by alternating large and small stars.

    Each round is joins and pre-aggregated minima; rounds are cut by a written table.
    """

    def mark(e):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(rows: DataFrame, radius: int = 3, max_group: int = MAX_GROUP, n_blocks: int | None = None) -> DataFrame:
    """From (doc_id, fp): doc_id, fp, n_near (other documents linked directly), component_id (smallest doc_id reachable).

    n_blocks: blocks that the fingerprint is cut into; by default as few as keep chance groups below one member.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the two-bit counters hold distances up to 3")
    rows = materialize(rows.select("doc_id", "fp"), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.count("*").alias("w"), F.min("doc_id").alias("m")), "distinct")
    n = distinct.count()
    if n_blocks is None:
        n_blocks = next((b for b in range(radius + 2, 9) if 64 * (b - radius) / b >= np.log2(max(n, 1))), 9)
    masks = table_masks(n_blocks, radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = distinct.select("fp", "w", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m, _, _ in masks])).alias("t", "key"))
    hot = keyed.groupBy("t", "key").count().where(F.col("count") > max_group).select(F.col("t").alias("ht"), F.col("key").alias("hk"), F.ceil(F.col("count") / max_group).alias("chunks"))
    hot = materialize(hot, "hot")
    chunked = keyed.join(hot, (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hk")), "left").select("t", "key", "fp", "w", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    chunked = chunked.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    pairs = chunked.select("t", "key", "fp", "w", "c", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o"))
    pairs = pairs.select("t", "key", (F.least("c", "o") * F.col("chunks") + F.greatest("c", "o")).alias("part"), "fp", "w", F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"))
    grouped = pairs.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "fp")
    links = materialize(grouped.mapInArrow(_linker(masks, radius), "fp long, near long, root long"), "links")
    near = links.groupBy("fp").agg(F.sum("near").alias("near")).withColumnRenamed("fp", "nfp")
    member = connected(links.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    least = distinct.join(member, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("m").alias("cid")).withColumnRenamed("root", "r")
    component = member.join(least, F.col("root") == F.col("r")).select("node", "cid")
    per_fp = distinct.join(near, F.col("fp") == F.col("nfp"), "left").join(component, F.col("fp") == F.col("node"), "left")
    per_fp = per_fp.select("fp", "w", (F.col("w") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.coalesce("cid", "m").alias("component_id"))
    # a fingerprint of empty or copied texts may be that of a third of all rows
    return by_key(rows, materialize(per_fp, "classes"), "fp", "w").select("doc_id", "fp", "n_near", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(fingerprints(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")
