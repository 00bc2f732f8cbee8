"""The queries of the ten operators over the whole of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunking, compaction, content_sort, context_mixing, fm_index, oracles, quality, secrets, simhash, toxicity
from .common import crc_bucket, shared_dir, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 7) == 2)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_bucket("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels"))
    scored, score = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= 0.5).cast("int").alias("predicted"),
        (F.col(score) >= toxicity.threshold(model)).alias("rejected"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stats = quality.kept(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = crc_bucket("doc_id", 3) == 1
    model = quality.fit(rows.where(~held), table(spark, sf_dir, "labels"), stats)
    scored, score = quality.score(rows, model, stats)
    return scored.select("doc_id", held.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of documents arrive in up to four batches; the rows of the last version, each with its shard's figures."""
    docs = table(spark, sf_dir, "documents")
    files = sorted(docs.inputFiles())
    store = compaction.Store(spark, shared_dir(spark))
    arrivals = [files[k :: min(4, len(files))] for k in range(min(4, len(files)))]
    for own in arrivals:
        store.append(spark.read.schema(docs.schema).parquet(*own))
    version = store.compact()
    figures = store.figures(version)
    return store.read(version, docs.schema).select("doc_id", F.length("text").alias("chars"), F.lit(version).alias("version"), *figures)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold no repeated passage have no row."""
    return chunking.passages(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, ids, decoded = bpe.round_trip(docs, tokenizer_path())
    return out.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, n = fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select(
        "doc_id",
        F.col(n["n_words"]).alias("n_words"),
        fm_index.hits(n["spans"]).alias("n_hit"),
        F.size(n["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(n["items"], ","), 256).alias("items_sha256"),
        fm_index.contaminated(n["n_words"], n["spans"]).alias("contaminated"),
    )


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
