"""Queries with exact contracts against brute force, on edge rows, an empty table and the smallest data."""

import pytest

from millrace.llm import queries as Q

from . import brute, edge


@pytest.fixture(scope="module", params=["edge", "empty", "data"])
def case(request, spark, sf_dir, tmp_path_factory):
    if request.param == "data":
        path = sf_dir
    else:
        path = edge.write(spark, tmp_path_factory.mktemp(request.param) / "in", rows=None if request.param == "edge" else [])
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    return path, docs, items


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_op1(spark, case):
    path, docs, _ = case
    got = Q.op1_secret_scan(spark, path)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(((d, *brute.secrets(t)) for d, t in docs), key=repr)


def test_op2(spark, case):
    path, docs, _ = case
    got = Q.op2_exact_dedup(spark, path)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(docs), key=repr)


def test_op4(spark, case):
    path, docs, _ = case
    prints = [(d, brute.fingerprint(t)) for d, t in docs]
    want = [(d, f"{fp:016x}", c) for (d, fp), c in zip(prints, brute.components(prints))]
    assert rows(Q.op4_simhash_dedup(spark, path), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_op8(spark, case):
    path, docs, _ = case
    want = [(d, *x) for (d, _), x in zip(docs, brute.bpe([t for _, t in docs], Q.tokenizer_path()))]
    assert rows(Q.op8_bpe(spark, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_op10(spark, case):
    path, docs, items = case
    want = [(d, *x) for (d, _), x in zip(docs, brute.contamination([t for _, t in docs], items))]
    assert rows(Q.op10_decontaminate(spark, path), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
