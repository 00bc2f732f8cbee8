"""A training corpus from documents: toxicity, exact and near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents, whatever further
columns come with them; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, content_sort, fm_index, set_join, toxicity
from millrace.llm.common import ascii_lower, crc_bucket, fresh, shared_dir, table
from millrace.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go.

    Null and empty texts are scored like others; repeated rows share their fate; without labels of both classes none goes.
    """
    model = toxicity.fit(docs.where(crc_bucket("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored, score = toxicity.score(docs, model, keep_text=True)
    return scored.where(F.col(score) < toxicity.threshold(model)).select(docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest id stays; of rows equal in id and text, one."""
    groups = content_sort.exact_groups(docs.select("doc_id", "text"), keep="largest")
    (key,) = fresh(docs, "key")
    kept = groups.where("kept").groupBy(F.concat_ws(":", "doc_id", "text_sha256").alias(key)).count()
    keyed = docs.withColumn(key, F.concat_ws(":", "doc_id", F.sha2(ascii_lower("text"), 256)))
    if kept.where("count > 1").limit(1).count():  # rows that only their place tells apart
        keyed = keyed.dropDuplicates([key])
    return keyed.join(kept.select(key), key, "left_semi").select(docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by pairs whose five-word shingles have a Jaccard similarity of 0.8 or more, one stays: the smallest id, null last (rows that share id and text stay together).

    The trees of fingerprints find the first links, all checked exactly; a join adds those beyond their bits.
    """
    groups = set_join.near_groups(docs)
    dropped = groups.where("not stays").select(F.col("doc_id").alias("gone"), F.col("tag").alias("gone_tag")).distinct()
    (tag,) = fresh(docs, "tag")
    marked = docs.withColumn(tag, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    met = marked["doc_id"].eqNullSafe(dropped["gone"]) & (marked[tag] == dropped["gone_tag"])
    return marked.join(dropped, met, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words one in twenty or more lies in benchmark windows go.

    Null and empty texts stay; repeated rows share their fate; with an empty benchmark all stay.
    """
    out, n = fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~fm_index.contaminated(n["n_words"], n["spans"])).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to.

    A row a document, also for null and empty texts (no ids) and for repeated rows; extra columns go.
    """
    out, ids, decoded = bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path())
    return out.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.col(ids).alias("ids"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL has neither the classifier nor XXH64 nor the tokenizer; tests compare with plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
