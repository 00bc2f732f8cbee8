"""Costly expressions are worked out once a row."""

from pyspark.sql import functions as F

from millrace.functions import fuzzy, sets
from millrace.functions import text as tx
from millrace.operators import vector


def planned(df):
    return df.toDF("out")._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_costly_within_a_lambda_or_twice(spark):
    df = spark.createDataFrame([("Ab cde 💡f", "abc"), ("", None)], "a string, b string")
    assert planned(df.select(tx.ngrams(F.col("a")))).count("lower(") == 1
    assert planned(df.select(vector.encode(F.col("a")))).count("lower(") == 1
    assert planned(df.select(sets.jaccard(tx.words(F.col("a")), tx.words(F.col("b"))))).count("lower(") == 2
    assert planned(df.select(fuzzy.set_ratio(tx.words(F.col("a")), tx.words(F.col("b"))))).count("lower(") == 2
    assert [r[0] for r in df.select(tx.ngrams(F.col("a"))).collect()] == [["abc", "bcd", "cde", "de💡", "e💡f"], []]
    assert [r[0] for r in df.select(tx.ngrams(F.col("b"))).collect()] == [["abc"], []]
