"""The corpus pipeline, stage by stage, against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sanctum.llm import mixing, packing, quality, secrets  # noqa: E402
from tests.llm.test_text_ops import brute_fingerprint, brute_links  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long"


def corpus():
    rng = random.Random(11)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(12, 30))) + "."
    rows = []
    for i in range(120):
        t = "\n".join(sentence() for _ in range(rng.randrange(2, 12)))
        if i % 10 == 1 and rows:
            t = rows[-1][1]
        if i % 10 == 2:
            t += "\npassword = hunter2222 and more words so that the line has at least ten of them."
        if i % 10 == 3:
            t = "Home | About | Contact\n" + t
        if i % 10 == 4:
            t = "Home | About | Contact\n" * 9
        rows.append((i, t, "en", rng.choice(["hot", "hot", "a", "b", None]), len(t), 7))
    rows += [(200, None, None, None, None, 7), (201, "", "en", "a", 0, 7), rows[5], rows[5]]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    columns = docs.columns

    def stage(i, df):
        out = corpus_pipeline.STAGES[i][1](spark, df, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{i}"))
        return spark.read.parquet(str(tmp_path / f"s{i}"))

    first = stage(0, docs)
    want = {}
    for r in rows:
        *_, kept, left = quality.examine(r[1].encode() if r[1] is not None else None)
        if kept:
            want.setdefault(r[0], []).append(b"\n".join(left).decode())
    got = {}
    for r in first.collect():
        assert r["n_chars"] == len(r["text"]) and r["copies"] == 7
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == want and first.columns == columns

    second = stage(1, first)
    ids = [(i, t) for i, ts in want.items() for t in ts]
    _, root = brute_links([brute_fingerprint(t) for _, t in ids])
    keep = {min(ids[j][0] for j in range(len(ids)) if root[j] == root[k]) for k in range(len(ids))}
    assert Counter(r["doc_id"] for r in second.collect()) == Counter(keep) and second.columns == columns

    third = stage(2, second)
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    assert texts == {i: secrets.mask(want[i][0].encode()).decode() for i in keep} and "hunter2222" not in "".join(texts.values()) and third.columns == columns

    fourth = stage(3, third)
    copies = Counter(r["doc_id"] for r in fourth.collect())
    source = {r[0]: r[3] for r in rows}
    size, taken = Counter(), Counter()
    for i in keep:
        n = len(texts[i].split())
        size[source[i]] += n
        taken[source[i]] += n * copies[i]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = mixing.water_fill(dict(size), mixing.cycle_weights(names), 1.5 * sum(size.values()), 2)
    assert fourth.columns == columns and set(copies) <= keep and max(copies.values()) <= 2
    assert all(abs(taken[s] - target[s]) <= 250 for s in names)

    last = corpus_pipeline.STAGES[4][1](spark, fourth, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    total = 0
    for i, n in copies.items():
        ids_ = np.array([*tk.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        pieces = [p for p in last if p["doc_id"] == i]
        assert sum(p["length"] for p in pieces) == n * len(ids_)
        assert all(zlib.crc32(ids_[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in pieces)
        total += n * len(ids_)
    by_seq = {}
    for p in last:
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert sum(p["length"] for p in last) == total and len(by_seq) <= -(-total // 4096) + 4


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    from sanctum.llm.common import WRITTEN, open_fs

    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    before = len(WRITTEN)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and sum(r["length"] for r in rows if r["doc_id"] == rows[0]["doc_id"]) % rows[0]["doc_tokens"] == 0
    own = WRITTEN[before:]
    assert any("/mixing-" in p for p in own) and not any(f"/{name}-" in p for p in own for name in ("quality_rules", "near_duplicates", "secrets", "edges", "decisions"))
    for p in own:
        fs, path = open_fs(p)
        assert fs.get_file_info(path).type.name == "Directory"
