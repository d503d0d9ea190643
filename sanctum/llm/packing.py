r"""Packing token sequences by non-negative least squares.

1. One pass tokenizes every document.  Of its ids it keeps the count and the CRC-32 of each cell of ``cell`` ids; the CRC
   of any run of cells follows from these, so ids are neither stored nor made twice.
2. A document of a full window or more is cut into windows and a remainder.  Remainders are binned by their cells (those
   under one cell by their exact length) and the histogram over all documents is taken.
3. The plan: shallow combinations that fill a window exactly (three bins, or any number of pieces of one or two) are the
   columns of a non-negative least squares problem against the histogram; repeat counts are rounded, and what that leaves
   is solved for again until nothing fits.
4. The residual is packed greedily: laid end to end and cut at windows, which cell boundaries allow.  Remainders under one
   cell lie end to end in windows of their own.

Every document's place is arithmetic on its rank in its bin.  Ranks are local counts of a written table plus offsets by
chunk and bin, so there is no global sort, and a bin with a third of all rows is never in one task.

The strings of a tokenizer's special tokens inside a text are ordinary text, as the vocabulary's own description has it, so no
text can hold a control id.

Edge cases: a null or empty text is the end token alone; repeated rows are packed each by itself; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_type, materialize, read_table, slices, utf8

WINDOW, CELL, END_ID = 4096, 16, 2
#: Distinct pieces kept by a worker, and bytes of text that it cuts at once.
CACHE_WORDS, CHUNK = 500_000, 1 << 21
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# == tokenizing ==

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each UTF-16 unit its class and its lower case.  OTHER is what only the tokenizer's own pipeline may split: signs from
    U+0300 on, controls, and letters whose lower case is not one unit."""
    kind, lower = np.full(1 << 16, _OTHER, np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for c in range(0x300):
        s = chr(c)
        if c == 0x20 or 0x09 <= c <= 0x0D:
            kind[c] = _SPACE
        elif s.isprintable() and len(s.lower()) == 1 and ord(s.lower()) < 1 << 16:
            kind[c] = _LETTER if regex.match(r"\p{L}", s) else _DIGIT if regex.match(r"\p{N}", s) else _SIGN
            lower[c] = ord(s.lower())
    return kind, lower


class WordEncoder:
    """Token ids of texts by a tokenizer that drops white space and never joins ids across it.

    Texts are lowered and cut into the tokenizer's pieces by arrays over all their signs; distinct pieces go through the
    tokenizer once and their ids are kept.  Beyond ``limit`` pieces those used least are dropped.  Words with any sign of class
    OTHER are one piece and go through the tokenizer's whole pipeline.  The tests hold the result against the tokenizer itself.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = self.parts.encode_special_tokens = True
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.parts.get_vocab_size()
        self.last = np.zeros(self.size, bool)
        for token, i in self.parts.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.kind, self.lower = _classes()
        self.limit = limit
        self.known = pa.array([], pa.binary())
        self.pool = np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.int32)
        self.length, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, pieces: pa.Array) -> None:
        units = np.frombuffer(pieces.buffers()[2], np.uint16) if pieces.buffers()[2] else np.zeros(0, np.uint16)
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] // 2
        other = np.concatenate([[0], np.cumsum(self.kind[units[at[0] : at[-1]]] == _OTHER)])[at - at[0]]
        other = np.diff(other) > 0
        words = [w.decode("utf-16-le") for w in pieces.to_pylist()]
        simple = [w for w, o in zip(words, other) if not o]
        length, ids = np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        if simple:
            ids = np.array(self.parts.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
            if len(ends) != len(simple) + 1:
                raise ValueError("the tokenizer joined or dropped words")
            length[~other] = np.diff(ends)
        if other.any():
            found = [e.ids for e in self.whole.encode_batch_fast([w for w, o in zip(words, other) if o], add_special_tokens=False)]
            length[other] = [len(f) for f in found]
            rest = np.array([i for f in found for i in f], np.int64)
            both = np.zeros(int(length.sum()), np.int64)
            of_other = np.repeat(other, length)
            both[of_other], both[~of_other] = rest, ids
            ids = both
        self.known = pa.concat_arrays([self.known, pieces])
        self.pool = np.concatenate([self.pool, ids.astype(self.pool.dtype)])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def _forget(self) -> None:
        """Keep the pieces used twice or more, at most half the limit; their uses count half from now on."""
        n = len(self.known)
        least = 2 if n <= self.limit // 2 else max(2, int(np.partition(self.uses, n - self.limit // 2)[n - self.limit // 2]))
        keep = np.flatnonzero(self.uses >= least)[: self.limit]
        ids = self._ids(keep).astype(self.pool.dtype)
        self.known = self.known.take(pa.array(keep))
        self.pool, self.length, self.uses = ids, self.length[keep], self.uses[keep] // 2

    def _ids(self, at: np.ndarray) -> np.ndarray:
        length = self.length[at]
        shift = np.cumsum(self.length, dtype=np.int64)[at] - np.cumsum(length)
        place = np.repeat(shift.astype(np.int32), length)
        place += np.arange(len(place), dtype=np.int32)
        return self.pool[place]

    def _cut(self, units: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Where the pieces of a run of UTF-16 units begin, and the pieces."""
        kind = self.kind[units]
        word = kind != _SPACE
        after_space = np.concatenate([[True], ~word[:-1]])
        begins = word & after_space
        low = self.lower[units]
        odd = kind == _OTHER
        start = begins.copy()
        start[1:] |= word[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        # contractions: an apostrophe that begins a piece, with s, t, m, d, re, ve or ll
        quote = np.flatnonzero((low == 0x27) & start)
        if len(quote):
            padded = np.concatenate([low, np.zeros(3, np.uint16)])
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, np.frombuffer("stmd".encode("utf-16-le"), np.uint16))
            two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
            start[quote[one | two] + 1] = False
            stop = np.concatenate([quote[one] + 2, quote[two] + 3])
            stop = stop[stop < len(units)]
            start[stop] |= word[stop]
        if odd.any():
            # words with a sign of class OTHER are one piece as they are
            number = np.cumsum(begins, dtype=np.int32)
            whole = np.zeros(int(number[-1]) + 1, bool)
            whole[number[odd]] = True
            whole = whole[number] & word
            start = np.where(whole, begins, start)
            low = np.where(whole, units, low)
        at, offset = np.flatnonzero(start), np.cumsum(word, dtype=np.int32)
        ends = np.append(offset[at] - 1, offset[-1]) * 2
        return at, pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(low[word])])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends in them."""
        out, counts = [], np.zeros(len(texts), np.int64)
        held: list[tuple[int, bytes]] = []
        size = 0

        def run():
            ids, of = self._encode(held)
            out.append(ids)
            np.add.at(counts, [i for i, _ in held], of)
            held.clear()

        for i, t in enumerate(texts):
            for part in _parts(t):
                held.append((i, part))
                size += len(part)
                if size >= CHUNK:
                    run()
                    size = 0
        if held:
            run()
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.cumsum(counts)

    def _encode(self, parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        units = [p.decode().encode("utf-16-le") for _, p in parts]
        ends = np.cumsum([len(u) // 2 + 1 for u in units])
        at, pieces = self._cut(np.frombuffer(b"\n\0".join(units) + b"\n\0", np.uint16))
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
        index = pc.index_in(pieces, self.known)
        if index.null_count:
            new = pieces.filter(index.is_null()).dictionary_encode()
            if len(self.known) + len(new.dictionary) > self.limit and len(self.known):
                self._forget()
                index = pc.index_in(pieces, self.known)
                new = pieces.filter(index.is_null()).dictionary_encode()
            index = np.array(index.fill_null(-1))
            index[index < 0] = len(self.known) + np.asarray(new.indices)
            self._learn(new.dictionary)
        else:
            index = np.asarray(index)
        self.uses += np.bincount(index, minlength=len(self.known))
        ids = self._ids(index).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(self.length[index], dtype=np.int64)])
        return ids, np.diff(np.concatenate([[0], total[np.searchsorted(at, ends)]]))


def _parts(text: bytes):
    """A text whole or, if it is very long, cut at white space, which ids never cross."""
    at = 0
    while len(text) - at > CHUNK:
        m = _BLANK.search(text, at + CHUNK)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def bin_of(length, cell: int = CELL):
    """Bins of remainders: 1 .. cell - 1 are exact lengths; cell + c holds those of c cells, rounded up; 0: none."""
    length = np.asarray(length)
    return np.where(length < cell, length, cell - 1 + -(-length // cell))


class CellCrcs:
    """CRC-32 of each cell of ids: a full cell's is the XOR of a table's entries, one for each id at its place in the cell."""

    def __init__(self, cell: int, ids: int):
        shift = _shift_tables(4)
        # an id's four bytes as the last of the cell, without the register's own start; then moved forward id by id
        none = zlib.crc32(bytes(4))
        crc = np.array([zlib.crc32(int(i).to_bytes(4, "little")) ^ none for i in range(ids)], np.uint64)
        self.tables = [crc]
        for _ in range(cell - 1):
            self.tables.append(_shift(shift, self.tables[-1]))
        self.tables = [t.astype(np.uint32) for t in reversed(self.tables)]
        self.cell, self.zero = cell, np.uint32(zlib.crc32(bytes(4 * cell)))

    def __call__(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(CRCs of all cells in a row, cells of each document) for documents of the given lengths, whose last cell may be short."""
        count = -(-lengths // self.cell)
        first, begin = np.cumsum(count) - count, np.cumsum(lengths) - lengths
        at = np.repeat(begin - self.cell * first, count) + self.cell * np.arange(int(count.sum()))
        short = np.flatnonzero(lengths % self.cell)
        full = np.ones(len(at), bool)
        full[(first + count - 1)[short]] = False
        out, start = np.zeros(len(at), np.uint32), at[full]
        crc = np.full(len(start), self.zero, np.uint32)
        for j, t in enumerate(self.tables):
            crc ^= t[ids[start + j]]
        out[full] = crc
        for i in short.tolist():
            end = begin[i] + lengths[i]
            out[first[i] + count[i] - 1] = zlib.crc32(ids[end - lengths[i] % self.cell : end].astype("<u4").tobytes())
        return out, count


def _tokenize(docs: DataFrame, path: str, window: int, cell: int, end_id: int) -> DataFrame:
    names = ["doc_id", "n", "crcs", "chunk", "bin", "rank", "windows_before"]

    def run(batches):
        enc, chunk = encoder(path), TaskContext.get().partitionId()
        crc_of = CellCrcs(cell, max(enc.size, end_id + 1))
        seen, windows = np.zeros(cell + window // cell + 1, np.int64), 0
        for b in slices(batches, 1024):
            ids, ends = enc.encode([t or b"" for t in utf8(b.column(1))])
            lengths = np.diff(np.concatenate([[0], ends])) + 1
            crcs, count = crc_of(np.insert(ids, ends, end_id), lengths)
            offsets = np.concatenate([[0], 4 * np.cumsum(count)]).astype(np.int64)
            crcs = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(crcs.astype("<u4"))]).cast(pa.binary())
            bins = bin_of(lengths % window, cell)
            rank = np.zeros(len(bins), np.int64)
            for i, k in enumerate(bins.tolist()):
                rank[i] = seen[k]
                seen[k] += 1
            full = lengths // window
            before = windows + np.cumsum(full) - full
            windows += int(full.sum())
            cols = [b.column(0), pa.array(lengths, pa.int64()), crcs, pa.array(np.full(len(bins), chunk, np.int64)), pa.array(bins.astype(np.int64)), pa.array(rank), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    source = docs
    return source.mapInArrow(run, f"doc_id {id_type(source, 'doc_id')}, n long, crcs binary, chunk long, bin long, rank long, windows_before long")


# == CRC-32 of joined runs ==


def _shift_tables(n_bytes: int) -> np.ndarray:
    """Tables (4, 256): XOR of their entries for the bytes of a CRC is that CRC after n_bytes more bytes, without them."""
    basis = np.zeros(32, np.uint64)
    zeros = bytes(n_bytes)
    none = zlib.crc32(zeros)
    for bit in range(32):
        basis[bit] = zlib.crc32(zeros, 1 << bit) ^ none
    tables = np.zeros((4, 256), np.uint64)
    for byte in range(4):
        for v in range(256):
            x = 0
            for bit in range(8):
                if v >> bit & 1:
                    x ^= int(basis[8 * byte + bit])
            tables[byte, v] = x
    return tables


def _shift(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & np.uint64(255)] ^ tables[1][crc >> np.uint64(8) & np.uint64(255)] ^ tables[2][crc >> np.uint64(16) & np.uint64(255)] ^ tables[3][crc >> np.uint64(24)]


class CrcJoiner:
    def __init__(self, cell: int):
        self.cell = cell
        self.tables = {k: _shift_tables(4 * k) for k in range(1, cell + 1)}

    def __call__(self, cells: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """CRC-32 of each run of cells; all cells are full but the last, lengths in ids."""
        count = np.array([len(c) for c in cells], np.int64)
        order = np.argsort(-count, kind="stable")
        offset = np.cumsum(count) - count
        flat = np.concatenate(cells).astype(np.uint64) if len(cells) else np.zeros(0, np.uint64)
        out = np.zeros(len(cells), np.uint64)
        if len(cells):
            out[:] = flat[offset]
        for k in range(1, int(count.max(initial=0))):
            own = order[: np.searchsorted(-count[order], -k, side="left")]
            nxt = flat[offset[own] + k]
            full = (count[own] > k + 1) | (lengths[own] == (k + 1) * self.cell)
            out[own[full]] = _shift(self.tables[self.cell], out[own[full]]) ^ nxt[full]
            for i in np.flatnonzero(~full):
                out[own[i]] = _shift(self.tables[int(lengths[own[i]] - k * self.cell)], out[own[i] : own[i] + 1])[0] ^ nxt[i]
        return out


# == the plan ==


def combinations(total: int, bins: list[int]) -> list[dict[int, int]]:
    """Ways to fill total exactly with bins (in cells), as bin -> times: at most three pieces of any bins, or any number of
    pieces of one bin or of two."""
    have, out = sorted(bins, reverse=True), []
    there = set(have)
    for i, a in enumerate(have):
        for n in range(1, total // a + 1):
            rest = total - n * a
            if not rest:
                out.append({a: n})
            else:
                out += [{a: n, b: rest // b} for b in have[i + 1 :] if rest % b == 0]
        for b in have[i + 1 :]:
            if total - a - b < b and total - a - b in there:
                out.append({a: 1, b: 1, total - a - b: 1})
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int | None = None) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets; b >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(steps or 3 * a.shape[0] + 10):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient)) if n else 0
        if not n or gradient[best] <= tol:
            break
        active[best] = True
        while True:
            s, own = np.zeros(n), a[:, active]
            try:
                s[active] = np.linalg.solve(own.T @ own, own.T @ b)
            except np.linalg.LinAlgError:
                s[active] = np.linalg.lstsq(own, b, rcond=None)[0]
            if (s[active] > 0).all():
                x = s
                break
            bad = active & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


def plan(histogram: dict[int, int], total: int, rounds: int = 8) -> list[tuple[dict[int, int], int]]:
    """Combinations of bins (in cells) and how often each is used; never more of a bin than there are.

    Counts are rounded down; what that leaves is solved for again until nothing more fits, then counts are rounded up,
    largest fractions first, while their bins last.
    """
    left, used = {k: v for k, v in histogram.items() if v}, {}
    for _ in range(rounds):
        combos = combinations(total, [k for k, v in left.items() if v])
        # a combination that asks for more of a bin than there is can't be used even once
        combos = [c for c in combos if all(n <= left[k] for k, n in c.items())]
        if not combos:
            break
        bins = sorted(k for k, v in left.items() if v)
        row = {k: i for i, k in enumerate(bins)}
        a = np.zeros((len(bins), len(combos)))
        for j, c in enumerate(combos):
            for k, n in c.items():
                a[row[k], j] = n
        x = nnls(a, np.array([left[k] for k in bins], float))
        before = sum(left.values())
        # least squares may ask for more of a bin than there is: counts are capped by what is left
        for most, asked in ((np.argsort(-x, kind="stable"), np.floor(x + 1e-6)), (np.argsort(-(x - np.floor(x)), kind="stable"), np.ceil(x - 1e-6))):
            for j in most:
                c, done = combos[j], used.get(tuple(combos[j].items()), 0)
                n = int(min([asked[j], *(left[k] // m for k, m in c.items())])) if asked[j] >= 1 else 0
                if n > 0:
                    used[tuple(c.items())] = done + n
                    for k, m in c.items():
                        left[k] -= n * m
            x = x - np.floor(x + 1e-6)
        if sum(left.values()) == before:
            break
    return [(dict(c), n) for c, n in used.items()]


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, cell: int = CELL, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece."""
    if window % cell:
        raise ValueError("window must be a multiple of cell")
    path, cells_in = tokenizer or default_tokenizer(), window // cell
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    t = materialize(_tokenize(source, path, window, cell, end_id), "tokens")
    kind = id_type(t, "doc_id")
    counts = materialize(t.groupBy("chunk", "bin").agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / window)).cast("long").alias("full")), "counts")
    histogram = {r["bin"]: r["c"] for r in counts.groupBy("bin").agg(F.sum("c").cast("long").alias("c")).collect()}  # at most cell + cells_in rows
    in_cells = {k - cell + 1: v for k, v in histogram.items() if k >= cell}
    chosen = plan(in_cells, cells_in)

    # sequence ids: full windows, then combinations, then small remainders by length, then the residual
    by_bin: dict[int, list[tuple[int, int, int, int]]] = {}
    planned: dict[int, int] = {}
    base = 0
    for combo, n in chosen:
        for slot, k in enumerate(chain.from_iterable(repeat(k, m) for k, m in combo.items())):
            by_bin.setdefault(k + cell - 1, []).append((planned.get(k + cell - 1, 0), n, base, slot))
            planned[k + cell - 1] = planned.get(k + cell - 1, 0) + n
        base += n
    # remainders under one cell lie end to end by length; one begins within the first window - cell + 1 ids of its sequence
    room, small_at, at = window - cell + 2, {}, 0
    for k in range(1, cell):
        small_at[k] = at
        at += k * histogram.get(k, 0)
    small_base = base
    base += -(-at // room)
    residual_base = base

    spark = docs.sparkSession
    planned_df = F.broadcast(spark.createDataFrame([(k, planned.get(k, 0)) for k in sorted(histogram)], "pb long, planned long"))
    w = Window.partitionBy("bin").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("rank_base", F.coalesce(F.sum("c").over(w), F.lit(0))).join(planned_df, F.col("bin") == F.col("pb"))
    # ranks from here on are residual; their lengths in cells follow from the bin
    offsets = offsets.withColumn("first", F.greatest("rank_base", F.least("planned", F.col("rank_base") + F.col("c"))))
    offsets = offsets.withColumn("cells", F.when(F.col("bin") >= cell, F.col("bin") - cell + 1).otherwise(0))
    offsets = offsets.withColumn("left_cells", (F.col("rank_base") + F.col("c") - F.col("first")) * F.col("cells"))
    per_chunk = offsets.groupBy("chunk").agg(F.sum("left_cells").alias("lc"), F.sum("full").alias("fw"))
    # one row a chunk: a running sum over the chunks of one table, not over documents
    run = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.select(F.col("chunk").alias("pc"), F.coalesce(F.sum("lc").over(run), F.lit(0)).alias("cell_base"), F.coalesce(F.sum("fw").over(run), F.lit(0)).alias("window_base"))
    inner = Window.partitionBy("chunk").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("own_cells", F.coalesce(F.sum("left_cells").over(inner), F.lit(0))).join(per_chunk, F.col("chunk") == F.col("pc"))
    offsets = offsets.select(F.col("chunk").alias("oc"), F.col("bin").alias("ob"), "rank_base", "first", (F.col("cell_base") + F.col("own_cells")).alias("cell_base"), "window_base")
    offsets = materialize(offsets.select("oc", "ob", *(F.col(c).cast("long").alias(c) for c in ("rank_base", "first", "cell_base", "window_base"))), "offsets")
    placed = t.join(offsets, (F.col("chunk") == F.col("oc")) & (F.col("bin") == F.col("ob")))
    placed = placed.select("doc_id", "n", "crcs", "bin", (F.col("rank_base") + F.col("rank")).alias("rank"), "first", "cell_base", (F.col("window_base") + F.col("windows_before")).alias("window_at"))
    n_full = counts.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]

    slots = {k: tuple(np.array(v, np.int64).T) for k, v in by_bin.items()}

    def place(batches):
        join = CrcJoiner(cell)
        for b in slices(batches, 1024):
            out, cells, lengths = [], [], []
            cols = [c.to_pylist() for c in b.columns[1:]]
            for i, (n, crcs, k, rank, first, cell_base, window_at) in enumerate(zip(*cols)):
                crc = np.frombuffer(crcs, "<u4")

                def piece(start, length, sequence, slot, i=i, crc=crc, n=n):
                    out.append((i, start, length, n, sequence, slot))
                    cells.append(crc[start // cell : -(-(start + length) // cell)])
                    lengths.append(length)

                for j in range(n // window):
                    piece(j * window, window, window_at + j, 0)
                start, left = n - n % window, n % window
                if not left:
                    continue
                if k < cell:
                    at = small_at[k] + rank * k
                    piece(start, left, n_full + small_base + at // room, at % room)
                elif rank < first:
                    begin, count, seq, slot = slots[k]
                    s = int(np.searchsorted(begin, rank, side="right")) - 1
                    piece(start, left, n_full + int(seq[s]) + rank - int(begin[s]), int(slot[s]))
                else:
                    at = cell_base + (rank - first) * (k - cell + 1)
                    while left:
                        take = min(left, (cells_in - at % cells_in) * cell)
                        piece(start, take, n_full + residual_base + at // cells_in, at % cells_in)
                        start, left, at = start + take, left - take, at + -(-take // cell)
            if not out:
                continue
            rows = np.array(out, np.int64)
            crc = join(cells, rows[:, 2])
            arrays = [b.column(0).take(pa.array(rows[:, 0])), *(pa.array(np.ascontiguousarray(rows[:, c])) for c in (1, 2)), pa.array(crc.astype(np.int64)), *(pa.array(np.ascontiguousarray(rows[:, c])) for c in (3, 4, 5))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    pieces = placed.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    # at most a window's worth of pieces in a group
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).drop("slot")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
