"""Look-ups by name, text and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .lexical import top


def by_name(names: DataFrame, rows: DataFrame, name: str, place: str) -> DataFrame:
    """name, the first place of that name in any case, and of exactly that name (null if none)."""
    first = rows.groupBy(F.lower(name).alias("__low")).agg(F.min(place).alias(place))
    exact = rows.groupBy(F.col(name).alias("__name")).agg(F.min(place).alias("exact_index"))
    met = names.join(first, F.lower("name") == F.col("__low")).join(exact, F.col("name") == F.col("__name"), "left")
    return met.select("name", place, "exact_index")


def last_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of rows with equal keys, the last value."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_of(rows: DataFrame, key: str, place: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(place).alias(place))


def cases(cases: DataFrame, qa: DataFrame) -> DataFrame:
    """Evaluation cases (case_id, original) with the idx of their question: the exact one, else the normalised one; the last of equal ones. Cases without any go."""
    exact = qa.groupBy(F.col("question").alias("original")).agg(F.max("idx").alias("by_text"))
    loose = qa.groupBy(tx.normalize(F.col("question")).alias("norm")).agg(F.max("idx").alias("by_norm"))
    met = cases.join(exact, "original", "left").withColumn("norm", tx.normalize(F.col("original"))).join(loose, "norm", "left")
    return met.select("case_id", F.coalesce("by_text", "by_norm").alias("idx")).where("idx is not null")


def first_there(*sources: Column) -> Column:
    """The first source that there is."""
    return F.coalesce(*sources)


def sample(rows: DataFrame, n: int, key: str, seed: int, by: str) -> DataFrame:
    """n rows of each group in an order that the seed makes: the same rows each time, wherever they lie."""
    return top(rows, n, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key), by=by).drop("rank")
