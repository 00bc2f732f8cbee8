"""Edits of topics with nested pairs, as expressions on the array; positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = "qa_pairs"


def _counted(topics: DataFrame) -> DataFrame:
    return topics.withColumn("qa_count", F.size(PAIRS))


def edit(topics: DataFrame, topic_index: int, at: int, question: str, answer: str) -> DataFrame:
    """Replace one pair's texts; its other fields stay."""
    changed = F.transform(PAIRS, lambda x, i: F.when(i == at, x.withField("question", F.lit(question)).withField("answer", F.lit(answer))).otherwise(x))
    return _counted(topics.withColumn(PAIRS, F.when(F.col("topic_index") == topic_index, changed).otherwise(F.col(PAIRS))))


def delete(topics: DataFrame, topic_index: Column, at: Column) -> DataFrame:
    """Drop the pairs at a set of positions; no positions drop the topic, and so does its last pair's end."""
    left = F.when(F.size(at) == 0, F.slice(PAIRS, 1, 0)).otherwise(F.filter(PAIRS, lambda x, i: ~F.array_contains(at, i)))
    return _counted(topics.withColumn(PAIRS, F.when(topic_index, left).otherwise(F.col(PAIRS)))).where(~topic_index | (F.size(PAIRS) > 0))


def pick(topics: DataFrame, at: Column) -> DataFrame:
    """Only the pairs at the given positions; those out of range are ignored."""
    return topics.withColumn(PAIRS, F.filter(PAIRS, lambda x, i: F.array_contains(at, i)))


def append(topics: DataFrame, pair: Column) -> DataFrame:
    """Add a pair to every topic; the others stay."""
    return _counted(topics.withColumn(PAIRS, F.array_append(PAIRS, pair)))


def replace(topics: DataFrame, change) -> DataFrame:
    """Change each pair by change(pair, position)."""
    return _counted(topics.withColumn(PAIRS, F.transform(PAIRS, change)))


def merged_text(texts: Column) -> Column:
    """Texts joined by a space, as merging falls back to."""
    return F.array_join(F.filter(texts, lambda x: F.trim(x) != ""), " ")


def pair_at(at: int) -> Column:
    """The pair at a position; an error if the topic has none there."""
    return F.when((F.lit(at) >= 0) & (F.size(PAIRS) > at), F.get(PAIRS, F.lit(at))).otherwise(F.raise_error(F.lit(f"no pair at {at}")).cast("void"))


def remove_at(topics: DataFrame, at: int) -> DataFrame:
    """Drop the pair at a position of every topic; an error in a topic that has none there."""
    left = F.filter(PAIRS, lambda x, i: i != at)
    return _counted(topics.withColumn(PAIRS, F.when((F.lit(at) >= 0) & (F.size(PAIRS) > at), left).otherwise(F.raise_error(F.lit(f"no pair at {at}")).cast("void"))))


# Answers of language services -----------------------------------------------------------------------


def lines(text: Column) -> Column:
    return F.posexplode(F.split(text, "\n")).alias("pos", "line")


def buckets(replies: DataFrame) -> DataFrame:
    """BUCKET_n: / Q: / ANSWER: lines of (id, text) to rows (id, bucket_id, q_index, question, answer); buckets without either are dropped."""
    line = replies.select("id", lines(F.col("text"))).withColumn("line", F.trim("line"))
    bucket = F.regexp_extract("line", r"^BUCKET_(\d+):", 1)
    from pyspark.sql.window import Window

    order = Window.partitionBy("id").orderBy("pos")
    own = line.withColumn("bucket", F.last(F.when(bucket != "", bucket), True).over(order)).where("bucket is not null")
    q, a = F.regexp_extract("line", r"^Q:\s*(.+)$", 1), F.regexp_extract("line", r"^ANSWER:\s*(.+)$", 1)
    per = own.groupBy("id", "bucket").agg(F.sort_array(F.collect_list(F.when(q != "", F.struct("pos", q.alias("q"))))).alias("qs"), F.max_by(F.when(a != "", a), F.when(a != "", F.col("pos"))).alias("answer"))
    return per.where("answer is not null").select("id", F.concat(F.lit("bucket_"), "bucket").alias("bucket_id"), F.posexplode("qs").alias("q_index", "x"), "answer").select("id", "bucket_id", "q_index", F.col("x.q").alias("question"), "answer")


def unified(replies: DataFrame, n: int = 10) -> DataFrame:
    """Q1: to Q10: and UNIFIED_ANSWER: lines of (id, text) to (id, questions, answer): padded with the last question, cut to n."""
    line = replies.select("id", lines(F.col("text"))).withColumn("line", F.trim("line"))
    q, a = F.regexp_extract("line", r"^Q\d+:\s*(.+)$", 1), F.regexp_extract("line", r"^UNIFIED_ANSWER:\s*(.+)$", 1)
    per = line.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.when(q != "", F.struct("pos", q.alias("q"))))), lambda x: x["q"]).alias("q"), F.max_by(F.when(a != "", a), F.when(a != "", F.col("pos"))).alias("answer"))
    padded = F.concat(F.col("q"), F.array_repeat(F.element_at("q", -1), F.greatest(F.lit(0), n - F.size("q"))))
    return per.where(F.size("q") > 0).select("id", F.slice(padded, 1, n).alias("questions"), "answer")


def alternating(replies: DataFrame) -> DataFrame:
    """Q…: / A…: lines of (id, text) to rows (id, n, question, answer): an answer belongs to the question before it."""
    from pyspark.sql.window import Window

    line = replies.select("id", lines(F.col("text"))).withColumn("line", F.trim("line"))
    q, a = F.regexp_extract("line", r"^Q\d*:\s*(.+)$", 1), F.regexp_extract("line", r"^A\d*:\s*(.+)$", 1)
    order = Window.partitionBy("id").orderBy("pos")
    own = line.select("id", "pos", F.when(q != "", q).alias("q"), F.when(a != "", a).alias("a")).withColumn("n", F.count("q").over(order)).where("n > 0")
    return own.groupBy("id", "n").agg(F.first("q", True).alias("question"), F.min_by("a", F.when(F.col("a").isNotNull(), F.col("pos"))).alias("answer")).where("answer is not null")


def merged_pair(text: Column) -> Column:
    """MERGED_QUESTION: / MERGED_ANSWER: of a reply; without marks, the first line and the rest."""
    q = F.trim(F.regexp_extract(text, r"(?s)MERGED_QUESTION:\s*(.*?)\s*(?:MERGED_ANSWER:|$)", 1))
    a = F.trim(F.regexp_extract(text, r"(?s)MERGED_ANSWER:\s*(.*)$", 1))
    first, rest = F.element_at(F.split(text, "\n", 2), 1), F.coalesce(F.try_element_at(F.split(text, "\n", 2), F.lit(2)), F.lit(""))
    return F.struct(F.when(q != "", q).otherwise(F.trim(first)).alias("question"), F.when(a != "", a).otherwise(F.trim(rest)).alias("answer"))


def requested(text: Column) -> Column:
    """What a reply asks for: type simplify if the word occurs, else unknown; topic from its last TOPIC: line, else all."""
    topics = F.regexp_extract_all(text, F.lit(r"TOPIC:([^\n]*?)(?:TOPIC:[^\n]*)?(?:\n|$)"), F.lit(1))
    kind = F.when(F.lower(text).contains("simplify"), "simplify").otherwise("unknown")
    return F.struct(kind.alias("type"), F.coalesce(F.trim(F.try_element_at(topics, F.lit(-1))), F.lit("all")).alias("topic"))


def embedded_json(text: Column, schema: str) -> Column:
    """The outermost object in a text, parsed; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def verdict(text: Column) -> Column:
    """Entailment, Contradiction or Neutral."""
    return F.when(F.contains(text, F.lit("Entailment")), "Entailment").when(F.contains(text, F.lit("Contradiction")), "Contradiction").otherwise("Neutral")
