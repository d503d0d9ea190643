r"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the sorted set of their sources): tokens and rows for each pattern.
2. Targets by water-filling: weights share a budget; a source stops at ``max_repeat`` times its tokens and the excess is
   shared again by weight.
3. A min-cost flow routes the capacity of the patterns to the quotas of the sources.  A pattern has one arc for each
   repetition, each dearer than the last, so nothing is repeated while fresh documents would do.
4. Of each pattern a seeded choice of documents brings its flow: repetitions that are full take all documents; the rest
   goes by the order of a seeded hash.  The pattern's rows are cut into hash buckets of about a thousand; buckets are
   taken whole up to the one where the flow ends, and within that one documents are taken while they fit.  So a source
   that holds a third of all rows is never in one task.

The flow is solved on the driver over one row per pattern; more than ``max_patterns`` patterns are refused, not cut.  Where no
document has two sources, as in ``op4_mixing``, the same solver runs, and its flow is each source's target.

Edge cases: a null or empty text has size 0 and is taken 0 times; a null source is a source, last in order; repeated rows
are documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, map_rows, materialize, read_table, small_table

MAX_PATTERNS = 100_000
BUCKET_ROWS = 1000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text, from the bytes of the whole column at once; null: 0."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(len(column), np.int64)
    word = ~_SPACE[np.frombuffer(data, np.uint8)[off[0] : off[-1]]]
    first = word.copy()
    first[1:] &= ~word[:-1]
    start = off[:-1] - off[0]
    inner = start[start < len(word)]
    first[inner] = word[inner]
    total = np.concatenate([[0], np.cumsum(first)])
    return (total[off[1:] - off[0]] - total[start]).astype(np.int64)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size)."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(word_counts(b.column(2)))], names=["doc_id", "source", "size"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, make, f"doc_id {id_type(source, 'doc_id')}, source {id_type(source, 'source')}, size long", 4096)


def water_fill(capacity: dict, weight: dict, total: float, max_repeat: float) -> dict:
    """Targets: total shared by weight, none above max_repeat times its capacity, the excess shared again."""
    target, free, left = {}, dict(weight), float(total)
    while free:
        unit = left / sum(free.values())
        over = [s for s in free if free[s] * unit > max_repeat * capacity[s]]
        if not over:
            return target | {s: w * unit for s, w in free.items()}
        for s in over:
            target[s] = float(max_repeat * capacity[s])
            left -= target[s]
            del free[s]
    return target


def min_cost_flow(arcs: list[tuple[int, int, float, float]], n: int, s: int, t: int) -> list[float]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a maximum flow of least cost.

    Primal-dual: shortest paths by reduced cost, then blocking flows over the arcs that lie on them, until t is out of reach.
    Rounds are as many as path costs differ (here: as repetitions), not as there are paths.
    """
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for u, v, c, w in arcs:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to += [v, u]
        cap += [float(c), 0.0]
        cost += [float(w), -float(w)]
    eps, potential = 1e-9 * max([1.0, *cap]), [0.0] * n
    while True:
        dist = [float("inf")] * n
        dist[s] = 0.0
        queue = [(0.0, s)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in head[u]:
                if cap[e] > eps:
                    nd = d + cost[e] + potential[u] - potential[to[e]]
                    if nd < dist[to[e]] - 1e-12:
                        dist[to[e]] = nd
                        heapq.heappush(queue, (nd, to[e]))
        if dist[t] == float("inf"):
            return [c - cap[2 * i] for i, (_, _, c, _) in enumerate(arcs)]
        for v in range(n):
            potential[v] += min(dist[v], dist[t])
        tight = lambda e, u: cap[e] > eps and abs(cost[e] + potential[u] - potential[to[e]]) < 1e-9
        while True:
            level = [-1] * n
            level[s] = 0
            front = [s]
            while front and level[t] < 0:
                reached = []
                for u in front:
                    for e in head[u]:
                        if level[to[e]] < 0 and tight(e, u):
                            level[to[e]] = level[u] + 1
                            reached.append(to[e])
                front = reached
            if level[t] < 0:
                break
            at, path = [0] * n, []  # a blocking flow: each arc is left behind once
            while True:
                u = to[path[-1]] if path else s
                if u == t:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path = path[: next(i for i, e in enumerate(path) if cap[e] <= eps)]
                    continue
                while at[u] < len(head[u]):
                    e = head[u][at[u]]
                    if level[to[e]] == level[u] + 1 and tight(e, u):
                        break
                    at[u] += 1
                else:
                    if not path:
                        break
                    at[to[path.pop() ^ 1]] += 1
                    continue
                path.append(e)


def route(patterns: list[tuple[tuple, int]], target: dict, max_repeat: int) -> list[float]:
    """Tokens to take of each pattern (members, tokens)."""
    names = sorted(target, key=_order)
    at = {name: 1 + len(patterns) + i for i, name in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    arcs = [(0, 1 + i, tokens, 4.0**r) for i, (_, tokens) in enumerate(patterns) for r in range(max_repeat)]
    own = len(arcs)
    arcs += [(1 + i, at[m], max_repeat * tokens, 0.0) for i, (members, tokens) in enumerate(patterns) for m in members]
    arcs += [(at[name], end, target[name], 0.0) for name in names]
    flow = min_cost_flow(arcs, end + 1, 0, end)
    return [sum(flow[i * max_repeat : (i + 1) * max_repeat]) for i in range(own // max_repeat)]


def _order(name):
    return (name is None, name or "")


def _fit(t: pa.Table) -> pa.Table:
    """The last bucket of a pattern: documents in seeded order while they fit, then one more if that comes nearer."""
    size = t["size"].to_numpy()
    # equal hash and size: copies of one row, of which any may be taken
    order = np.lexsort((size, t["h"].to_numpy()))
    left, extra = float(t["gap"][0].as_py()), np.zeros(len(size), np.int64)
    for i in order.tolist():
        if 0 < size[i] <= left:
            extra[i], left = 1, left - size[i]
    rest = [i for i in order.tolist() if not extra[i] and size[i]]
    if rest:
        i = min(rest, key=lambda i: abs(left - size[i]))
        if abs(left - size[i]) < left:
            extra[i] = 1
    return t.select(["doc_id", "pattern", "size", "full"]).append_column("extra", pa.array(extra))


def mix(docs: DataFrame, weights, share: float = 1.5, max_repeat: int = 2, seed: int = 7, max_patterns: int = MAX_PATTERNS, order_by: str = "doc_id") -> DataFrame:
    """From (doc_id, sources array<string>, size): (doc_id, sources, size, taken, copies).

    order_by: what of doc_id, which may be a struct, the seeded order depends on.

    weights: function of the sorted source names, a dict name -> weight.  share: budget as a part of all tokens.
    ``result.targets`` and ``result.source_sizes`` hold the quotas and sizes by source.
    """
    spark = docs.sparkSession
    # a pattern's key: its sorted members, null last, escaped so that no two sets look alike
    key = lambda a: F.array_join(F.transform(a, lambda x: F.when(x.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.regexp_replace(x, r"([\\,])", r"\\$1")))), ",")
    members = F.array_sort(F.array_distinct("sources"))
    rows = materialize(docs.select("doc_id", members.alias("sources"), "size").withColumn("pattern", key(F.col("sources"))), "sizes")
    head = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("tokens"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(head) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns: raise max_patterns or merge sources")
    head.sort(key=lambda r: r["pattern"])
    size_of: dict = {}
    for r in head:
        for s in r["sources"]:
            size_of[s] = size_of.get(s, 0) + r["tokens"]
    names = sorted(size_of, key=_order)
    target = water_fill(size_of, weights(names), share * sum(r["tokens"] for r in head), max_repeat)
    amounts = route([(tuple(r["sources"]), r["tokens"]) for r in head], target, max_repeat)
    plan = []
    for r, amount in zip(head, amounts):
        full = min(int(amount // r["tokens"]), max_repeat) if r["tokens"] else 0
        plan.append((r["pattern"], full, float(amount - full * r["tokens"]), max(1, -(-r["n"] // BUCKET_ROWS))))
    plan_df = small_table(spark, plan, "p string, full long, rest double, buckets long")
    placed = rows.join(plan_df, F.col("pattern") == F.col("p")).withColumn("h", F.xxhash64(order_by, F.lit(seed)))
    placed = placed.withColumn("bucket", F.pmod("h", "buckets"))
    from pyspark.sql import Window

    filled = placed.where("rest > 0").groupBy("pattern", "bucket").agg(F.sum("size").alias("b"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("b").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = filled.select("pattern", "bucket", "b", "rest", before.alias("before")).where("before < rest and before + b >= rest")
    ends = materialize(ends.select(F.col("pattern").alias("ep"), F.col("bucket").alias("eb"), (F.col("rest") - F.col("before")).alias("gap")), "ends")
    # written, so Spark broadcasts it only below its threshold
    marked = placed.join(ends, F.col("pattern") == F.col("ep"), "left")
    whole = marked.where("eb is null or bucket <> eb").select("doc_id", "pattern", "size", "full", F.when(F.col("bucket") < F.col("eb"), 1).otherwise(0).cast("long").alias("extra"))
    kind = id_type(rows, "doc_id")
    last = marked.where("bucket = eb").select("doc_id", "pattern", "size", "full", "h", "gap", "bucket")
    last = last.groupBy("pattern", "bucket").applyInArrow(_fit, f"doc_id {kind}, pattern string, size long, full long, extra long")
    taken = whole.unionByName(last).withColumn("taken", (F.col("full") + F.col("extra")) * F.col("size"))
    # the members are read back from the plan: one short row a pattern
    sources = small_table(spark, [(r["pattern"], list(r["sources"])) for r in head], "sp string, sources array<string>")
    out = taken.join(sources, F.col("pattern") == F.col("sp")).select("doc_id", "sources", "size", "taken", (F.col("full") + F.col("extra")).alias("copies"))
    out.targets, out.source_sizes = target, size_of
    return out


def cycle_weights(names: list, cycle=(5, 2, 1)) -> dict:
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(names)}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sizes(read_table(spark, sf_dir, "documents"))
    mixed = mix(docs.select("doc_id", F.array("source").alias("sources"), "size"), cycle_weights)
    per_source = [(s, int(n), float(mixed.targets[s])) for s, n in mixed.source_sizes.items()]
    table = small_table(spark, per_source, "name string, source_size long, target double")
    joined = mixed.join(table, F.col("sources")[0].eqNullSafe(F.col("name")))
    return joined.select("doc_id", F.col("size").cast("long").alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"))
