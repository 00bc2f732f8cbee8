"""Paths of conversations that are long, and of nodes that no root reaches."""

import pytest

from millrace import catalog
from millrace.operators import crawl


def test_paths_of_long_conversations(spark, tmp_path):
    turns = [(1, t) for t in range(1_300)] + [(2, t) for t in range(400)]
    spark.createDataFrame([(c, t, "u", "") for c, t in turns], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["relabel_paths"](spark, str(tmp_path)).collect())
    assert got == sorted((c * 1000 + t, "/".join(f"u{k}" for k in range(t + 1))) for c, t in turns)


def test_paths_beyond_the_depth_and_of_circles(spark):
    chain = spark.createDataFrame([(0, None, "r"), *((k, k - 1, "x") for k in range(1, 40))], "ord long, parent_ord long, label string")
    with pytest.raises(RuntimeError):
        crawl.relabel(chain, 9)
    nodes = spark.createDataFrame([(0, None, "r"), (1, 0, "a"), (2, 3, "b"), (3, 2, "c"), (4, 3, "d"), (5, 99, "e")], "ord long, parent_ord long, label string")
    assert {r["ord"]: r["path"] for r in crawl.relabel(nodes).collect()} == {0: "r", 1: "r/a"}
