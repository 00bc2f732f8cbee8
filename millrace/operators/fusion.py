"""Fusing ranked lists and scores. Input lists are long tables (query_id, retriever, idx, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of the four retrievers, and the constant of reciprocal ranks.
WEIGHTS = {"filtered_semantic": 1.5, "bm25": 1.0, "question_semantic": 1.2, "answer_semantic": 0.8}
RRF_K, RRF_LEAST = 60, 0.02


def lists(**named: DataFrame) -> DataFrame:
    out = None
    for name, df in named.items():
        own = df.select("query_id", F.lit(name).alias("retriever"), "idx", "score", "rank")
        out = own if out is None else out.unionByName(own)
    return out


def rrf(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, shift: int = 0) -> DataFrame:
    """Weighted reciprocal rank fusion: sum of w / (k + rank), votes and sources; shift 1 counts ranks from 0."""
    if weights is None:
        w = F.lit(1.0)
    else:
        w = F.lit(None).cast("double")
        for name, value in weights.items():
            w = F.when(F.col("retriever") == name, F.lit(float(value))).otherwise(w)
    part = w / (k + F.col("rank") - shift)
    return ranked.groupBy("query_id", "idx").agg(F.sum(part).alias("score"), F.count("*").alias("votes"), F.array_join(F.sort_array(F.collect_set("retriever")), ",").alias("sources"))


def hybrid(semantic: DataFrame, lexical: DataFrame, alpha: float) -> DataFrame:
    """alpha x semantic + (1 - alpha) x lexical over the query's largest; rows of either side."""
    most = F.max("score").over(Window.partitionBy("query_id"))
    lex = lexical.select("query_id", "idx", F.when(most > 0, F.col("score") / most).otherwise(0.0).alias("lex"))
    sem = semantic.select("query_id", "idx", F.col("score").alias("sem"))
    both = sem.join(lex, ["query_id", "idx"], "full_outer").fillna(0.0, ["sem", "lex"])
    a, b = alpha * F.col("sem"), (1 - alpha) * F.col("lex")
    return both.select("query_id", "idx", "sem", "lex", (a + b).alias("score"), F.when(a >= b, "semantic").otherwise("lexical").alias("dominant"))


METHODS = ("avg", "avg6", "fam_avg", "fam_wt", "kw_pen", "geo", "rtr_dom", "harm")


def families(scores: DataFrame) -> DataFrame:
    """Eight ways to merge seven algorithms' scores (rtr, bm25, norm, stem, fuzz, cos, ngram; null is 0) of rows that two agree on."""
    own = ["rtr", "cos", "bm25", "norm", "stem", "fuzz", "ngram"]
    s = scores.fillna(0.0, own)
    s = s.where(sum((F.col(c) > 0).cast("int") for c in own) >= 2)
    kw, text, sem = F.greatest("rtr", "bm25"), F.greatest("norm", "stem", "fuzz"), F.col("cos")
    all_in = (kw > 0) & (text > 0) & (sem > 0)
    total = sum(F.col(c) for c in own)
    weighted = 0.5 * kw + 0.3 * text + 0.2 * sem
    return s.select(
        "query_id", "idx",
        (total / 7).alias("avg"), ((total - F.col("ngram")) / 6).alias("avg6"), ((kw + text + sem) / 3).alias("fam_avg"), weighted.alias("fam_wt"),
        F.when(kw == 0, 0.3 * text + 0.2 * sem).otherwise(weighted).alias("kw_pen"),
        F.when(all_in, F.pow(kw * text * sem, F.lit(1 / 3))).otherwise(0.0).alias("geo"),
        (0.6 * F.col("rtr") + 0.2 * text + 0.2 * sem).alias("rtr_dom"),
        F.when(all_in, 3 / (F.try_divide(F.lit(1.0), kw) + F.try_divide(F.lit(1.0), text) + F.try_divide(F.lit(1.0), sem))).otherwise(0.0).alias("harm"),
    )


def best_each(merged: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """The first row of every query under each method."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods))).alias("p")
    long = merged.select("query_id", "idx", pairs).select("query_id", "idx", "p.*")
    return long.groupBy("query_id", "method").agg(F.max_by("idx", F.struct("score", -F.col("idx"))).alias("idx"), F.max("score").alias("score"))


def cascade(stages: list[tuple[int, str, DataFrame, float]], queries: DataFrame) -> DataFrame:
    """Of the stages' candidates that reach their threshold, the best (the earlier stage on ties); else a fallback row."""
    pool = None
    for place, name, df, least in stages:
        own = df.where(F.col("score") >= least).select("query_id", F.lit(place).alias("stage"), F.lit(name).alias("source"), "idx", "score")
        pool = own if pool is None else pool.unionByName(own)
    first = pool.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "stage", "idx"))).where("r = 1").drop("r", "stage")
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce("source", F.lit("fallback")).alias("source"), "idx", "score")


def floor(fused: DataFrame, least: float = RRF_LEAST) -> DataFrame:
    """Mark rows below the smallest fused score that counts as an answer."""
    return fused.withColumn("answered", F.col("score") >= least)


def reranked(candidates: DataFrame, logit, least: float = 0.5) -> DataFrame:
    """Candidates by an injected scorer's logit (a column), as a probability; passed marks those from least on."""
    score = F.round(1 / (1 + F.exp(-logit)), 6)
    out = candidates.withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")
    return out.select("query_id", "idx", "score", (F.col("score") >= least).alias("passed"), F.row_number().over(order).alias("rank"))


def verified(best: DataFrame, queries: DataFrame, qa: DataFrame, verify) -> DataFrame:
    """Answers (query_id, idx, score) with the verdict of an injected verifier (query and answer columns to a column); only entailed ones stay answers."""
    texts = best.join(queries.select("query_id", "query"), "query_id").join(qa.select("idx", "answer"), "idx")
    verdict = verify(F.col("query"), F.col("answer"))
    return texts.select("query_id", "idx", "score", verdict.alias("verdict")).withColumn("accepted", F.col("verdict") == "Entailment")


def rescored(candidates: DataFrame, queries: DataFrame, qa: DataFrame, rerank, least: float = 0.5) -> DataFrame:
    """Candidates by an injected reranker's logit of query and pair, as reranked() has them."""
    texts = candidates.select("query_id", "idx").distinct().join(queries.select("query_id", "query"), "query_id").join(qa.select("idx", F.concat_ws(" ", "question", "answer").alias("pair")), "idx")
    return reranked(texts, rerank(F.col("query"), F.col("pair")), least)


def filtered(queries: DataFrame, qa: DataFrame, entities) -> DataFrame:
    """Pairs that each query's entities leave: those with one of them in question or answer (query_id, idx); a query without entities has none.

    entities is an injected column function from a query to an array of names, which are words of the normalised text.
    """
    from ..functions import text as tx

    named = queries.select("query_id", F.explode(entities(F.col("query"))).alias("word"))
    words = qa.select("idx", F.explode(tx.words(F.concat_ws(" ", "question", "answer"))).alias("word"))
    return named.join(words, "word").select("query_id", "idx").distinct()
