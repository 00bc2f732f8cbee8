"""Tables of an input folder, and the knowledge base that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer pairs: a user's turn that an assistant's follows. idx orders them by conversation and place.

    idx is made from both numbers, so that no partition has to see all rows.
    """
    turns = Window.partitionBy("conv_id").orderBy("turn")
    chat = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(turns).alias("next"), F.lead("text").over(turns).alias("answer"))
    own = chat.where("role = 'user' and next = 'assistant'").withColumn("qa_index", F.row_number().over(turns) - 1)
    return own.select(
        (F.col("conv_id") * 1048576 + F.col("qa_index")).alias("idx"), F.col("conv_id").alias("topic_index"), "qa_index",
        F.concat(F.lit("topic "), F.col("conv_id").cast("string")).alias("topic"), F.col("text").alias("question"), "answer",
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries of all searches: every benchmark text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def topics(qa: DataFrame) -> DataFrame:
    """Pairs nested below their topic, in order."""
    pair = F.struct("qa_index", "question", "answer")
    return qa.groupBy("topic_index", "topic").agg(F.sort_array(F.collect_list(pair)).alias("qa_pairs"))


#: The same in SQL, to begin a WITH list.
QA_SQL = """turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS qa_index FROM turns WHERE role = 'user' AND next = 'assistant'),
qa AS (SELECT conv_id * 1048576 + qa_index AS idx, conv_id AS topic_index, CAST(qa_index AS INTEGER) AS qa_index, 'topic ' || conv_id AS topic, text AS question, answer FROM own),
ask AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""
