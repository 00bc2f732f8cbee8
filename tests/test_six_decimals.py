"""Scores that are compared after rounding, to the last decimal."""

import os

import duckdb
import pytest

from millrace import catalog
from millrace.operators import lexical, vector

QA = [(7, "alpha beta gamma delta epsilon", "alpha beta zeta")]


def test_rerank_rounds_the_likeness_of_spelling(spark):
    q = spark.createDataFrame([(1, "alpha beta thetas")], "query_id long, query string")
    qa = spark.createDataFrame(QA, "idx long, question string, answer string")
    found = spark.createDataFrame([(1, 7, 0.5)], "query_id long, idx long, idf_score double")
    rest = 0.30 * 0.5 + 0.45 * 2 / 3 + 0.10 * 2 / 6 + 0.05 * 2 / 4 + 0.05 * 7 / 15
    (score,) = (r["score"] for r in lexical.rerank(q, qa, found).collect())
    assert abs(score - rest - 0.05 * round(10 / 17, 6)) < 1e-12


@pytest.mark.parametrize("name", ["rtr_search", "family_fusion"])
def test_same_as_sql_in_every_decimal(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("benchmark", "conversations"):
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    have = catalog.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    both = have.merge(want, on=["query_id", "idx"], suffixes=("", "_sql"))
    assert len(both) == len(have) == len(want)
    floats = [c for c in want.columns if c not in ("query_id", "idx")]
    assert all((both[c] - both[f"{c}_sql"]).abs().max() < 1e-9 for c in floats)


def test_vectors_are_compared_after_rounding(spark):
    """A cosine just below the threshold rounds up to it, and one just below the k-th is equal to it."""
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = spark.createDataFrame([(1, at(0.34999960)), (2, at(0.34999940)), (3, at(0.35000010))], "idx long, vec array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    assert sorted(r["idx"] for r in vector.search(q, rows, None, least=0.35).collect()) == [1, 3]
    assert [r["idx"] for r in vector.search(q, rows, 1).collect()] == [1]
