"""Decisions by position, and the shared folder."""

import pytest
from pyspark.sql import functions as F

from sanctum.llm import common


@pytest.mark.parametrize("files", [0, 1, 7])
def test_by_position(spark, tmp_path, files):
    rows = [(i % 50, f"t{i}", {"a": i}, None) for i in range(200)]  # ids repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, file string")
    if files:
        docs.repartition(files).write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    placed = common.row_id(common.positioned(docs), "doc_id")
    copies = (F.substring("text", 2, 9).cast("int") % 4).alias("copies")
    decisions = placed.select("__id.file", "__id.row", copies).where("copies > 0")
    out = common.by_position(placed, decisions)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["m"]["a"]) for r in out.collect()) == sorted((i % 50, f"t{i}", i) for i in range(200) for _ in range(i % 4))
    assert common.by_position(placed, decisions.where("false")).collect() == []


def test_shared_dir_is_the_sessions(spark):
    assert common.shared_dir(spark).removeprefix("file:").replace("///", "/") == spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    fs, path = common.open_fs(common.shared_dir(spark))
    assert path.startswith("/")
