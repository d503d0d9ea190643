r"""Token counts under a unigram vocabulary by dynamic programming over a trie.

Pre-tokens are the white-space words of a text, each with the mark U+2581 before it.  The best segmentation of a pre-token
has the highest sum of piece scores, of equal sums the fewest pieces; a character that no piece covers costs its UTF-8
bytes as byte pieces.  The distinct pre-tokens of a batch are inserted in a trie in sorted order, that is depth first: the
forward score and count at a node depend on the path to it alone, so they are computed once for each shared prefix and
kept on a stack; the count at a pre-token's last node is its own.

Scores are those of a fixed public vocabulary; by default of piece ranks r, -log(r + 2), as a rank-frequency law has it.
Nothing is trained.  Counts of words seen are kept by each worker, up to ``limit``; there is no shuffle.

Edge cases: a null or empty text has no tokens; repeated rows are counted alike; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, map_rows, read_table, utf8

MARK = "▁"
CACHE_WORDS = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> dict[str, float]:
    """Pieces and their scores, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): -math.log(i + 2) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


class TrieCounter:
    def __init__(self, scores: dict[str, float], byte_score: float | None = None, limit: int = CACHE_WORDS):
        self.scores, self.limit = scores, limit
        self.byte_score = byte_score if byte_score is not None else min(scores.values(), default=0.0) - 1.0
        self.known: dict[bytes, int] = {}
        # for each last character, the lengths of pieces that end in it
        ends: dict[str, set[int]] = {}
        for p in scores:
            ends.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: tuple(sorted(n)) for c, n in ends.items()}

    def learn(self, words: list[bytes]) -> None:
        """Counts of new words, in one walk over their trie."""
        scores, lengths, byte_score = self.scores, self.lengths, self.byte_score
        path = MARK
        # best[i]: (score, -pieces) of the best segmentation of path[:i]
        best: list[tuple[float, int]] = [(0.0, 0)]
        self._extend(best, path, 0)
        known = self.known
        for text, word in sorted((MARK + w.decode(), w) for w in words):
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :]
            path = text
            for i in range(shared, len(text)):
                c = text[i]
                n = len(c.encode())
                s, k = best[i]
                top = (s + n * byte_score, k - n)
                for size in lengths.get(c, ()):
                    if size > i + 1:
                        break
                    score = scores.get(text[i + 1 - size : i + 1])
                    if score is not None:
                        s, k = best[i + 1 - size]
                        if (s + score, k - 1) > top:
                            top = (s + score, k - 1)
                best.append(top)
            known[word] = -best[-1][1]

    def _extend(self, best, path, start):
        for i in range(start, len(path)):
            c, (s, k) = path[i], best[i]
            n = len(c.encode())
            top = (s + n * self.byte_score, k - n)
            for size in self.lengths.get(c, ()):
                if size <= i + 1 and (score := self.scores.get(path[i + 1 - size : i + 1])) is not None:
                    s, k = best[i + 1 - size]
                    top = max(top, (s + score, k - 1))
            best.append(top)

    def counts(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        words = [t.split() for t in texts]
        new = [w for w in set().union(*words) if w not in self.known]
        if len(self.known) + len(new) > self.limit and self.known:
            self.known.clear()
            new = list(set().union(*words))
        self.learn(new)
        get = self.known.__getitem__
        return [(len(ws), sum(map(get, ws))) for ws in words]


_COUNTERS: dict[str, TrieCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens)."""
    path = vocabulary or default_vocabulary()

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _COUNTERS:
            _COUNTERS[path] = TrieCounter(load(path))
        found = _COUNTERS[path].counts([t or b"" for t in utf8(b.column(1))])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, make, f"doc_id {id_type(source, 'doc_id')}, n_words long, n_tokens long", 2048)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
