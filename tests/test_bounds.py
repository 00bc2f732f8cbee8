"""Rows that must not be lost: vectors of odd lengths, long chains, keys over several batches."""

import random

from millrace.operators import dedup, vector
from millrace.streaming import progress


def scan(nodes, edges):
    lead = {}
    for n in sorted(nodes):
        lead[n] = min((lo for lo, hi in edges if hi == n and lead.get(lo) == lo), default=n)
    return lead


def test_vectors_of_other_lengths_are_left_out_alone(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None])], "idx long, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, None)], "query_id long, vec array<double>")
    got = {(r["query_id"], r["idx"], round(r["score"], 3)) for r in vector.search(queries, rows).collect()}
    assert got == {(7, 1, 1.0), (7, 3, 0.707), (8, 2, 0.577)}
    assert {(r["query_id"], r["idx"]) for r in vector.search(queries, rows, 1).collect()} == {(7, 1), (8, 2)}
    assert vector.search(queries.where("false"), rows, 1).count() == 0


def test_leaders_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(250)]
    got = dict(map(tuple, dedup.leaders(spark.range(252), spark.createDataFrame(edges, "lo long, hi long")).collect()))
    assert got == scan(range(252), edges)


def test_leaders_by_rounds_and_by_scan(spark):
    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    frame = spark.createDataFrame(edges, "lo long, hi long")
    for few in (0, 40):
        assert dict(map(tuple, dedup.leaders(spark.range(60), frame, few).collect())) == scan(range(60), edges)


def test_update_mode_keeps_keys_of_earlier_batches(spark, tmp_path):
    def put(n, rows):
        made = spark.createDataFrame([(i, u, k) for i, u, k in rows], "event_id long, user_id long, event_type string")
        made.selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "event_type", "1.0D AS value", "'' AS props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(0, [(1, 10, "view"), (2, 11, "purchase")])
    put(1, [(3, 12, "error"), (4, 10, "view")])
    run = lambda: {tuple(r) for r in progress.drained(progress.fold(progress.source(spark, str(tmp_path / "in"))), str(tmp_path / "out"), "update", ("node",)).collect()}
    assert run() == {(10, "processing", 2), (11, "completed", 1), (12, "error", 1)}
    put(2, [(5, 11, "view")])
    assert run() == {(10, "processing", 2), (11, "completed", 2), (12, "error", 1)}  # resumed, not run anew
