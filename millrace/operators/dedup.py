"""Near-duplicate clustering of question-answer pairs in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import folder, kept

# Thresholds for questions and answers.
GREEDY_Q, GREEDY_A = 0.90, 0.95
ONLINE_Q, ONLINE_A = 0.92, 0.90


#: Open links that one task finishes by the plain scan.
FEW = 100_000


def _scan(state: DataFrame, edges: DataFrame) -> DataFrame:
    """The plain scan over few open links, in one task: id, leader. state (id, leader) has what is decided among their lower ends."""

    def scan(pdf):
        import pandas as pd

        lead, out = {}, []
        known = pdf[pdf["lead"].notna()]
        lead.update(zip(known["lo"].tolist(), known["lead"].astype("int64").tolist()))
        for hi, own in pdf.sort_values(["hi", "lo"]).groupby("hi", sort=True):
            near = next((lo for lo in own["lo"].tolist() if lead.get(lo) == lo), hi)
            lead[hi] = near
            out.append((hi, near))
        return pd.DataFrame(out, columns=["id", "leader"])

    met = edges.join(state.select(F.col("id").alias("lo"), F.col("leader").alias("lead")), "lo", "left")
    return met.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(scan, "id long, leader long")


def leaders(nodes: DataFrame, edges: DataFrame, few: int = FEW) -> DataFrame:
    """Nodes (id) that a scan in order of id keeps: id, leader (itself if kept), for edges (lo, hi), lo < hi.

    A node leads once all its smaller neighbours are absorbed, and is absorbed once a smaller
    neighbour leads; it belongs to the smallest that does. Equal to the sequential loop. Each round
    decides at least the smallest open node and writes what it decided only; once no more than few
    links are open, one task ends the scan.
    """
    spark, path = nodes.sparkSession, folder(nodes.sparkSession)
    cast = lambda df, *names: df.select(*(F.col(n).cast("long").alias(n) for n in names))
    open_edges = kept(cast(edges, "lo", "hi").where("lo < hi").distinct())
    free = cast(nodes, "id").distinct().join(open_edges.select(F.col("hi").alias("id")).distinct(), "id", "left_anti")
    free.select("id", F.col("id").alias("leader")).write.parquet(path)
    state = lambda: spark.read.schema("id long, leader long").parquet(path)
    while left := open_edges.limit(few + 1).count():
        if left <= few:
            _scan(state(), open_edges).write.mode("append").parquet(path)
            break
        known = state().select(F.col("id").alias("lo"), F.col("leader").alias("lead"))
        per = open_edges.join(known, "lo", "left").groupBy(F.col("hi").alias("id")).agg(
            F.min(F.when(F.col("lead") == F.col("lo"), F.col("lo"))).alias("near"),
            F.min(F.when(F.col("lead").isNull(), F.col("lo"))).alias("unsure"),
        )
        # Absorbed by a leader that no undecided node could come before, or leading as all smaller neighbours are absorbed.
        done = per.where("near is not null and (unsure is null or near < unsure)").select("id", F.col("near").alias("leader"))
        done = kept(done.unionByName(per.where("near is null and unsure is null").select("id", F.col("id").alias("leader"))))
        done.write.mode("append").parquet(path)
        open_edges = kept(open_edges.join(done.select(F.col("id").alias("hi")), "hi", "left_anti"))
    return state()


def report(state: DataFrame, qa: DataFrame, answers: DataFrame, least: float = GREEDY_A) -> DataFrame:
    """One row an absorbed pair: discarded if its answer is as near to the leader's (answers: lo, hi, score), else merged."""
    gone = state.where("id <> leader").join(answers.select(F.col("lo").alias("leader"), F.col("hi").alias("id"), "score"), ["leader", "id"], "left")
    action = F.when(F.col("score") >= least, "DISCARDED").otherwise("MERGED")
    return gone.join(qa.select(F.col("idx").alias("id"), "question", "answer"), "id").select("id", "leader", action.alias("action"), "question", "answer")


def merged(state: DataFrame, qa: DataFrame, log: DataFrame) -> DataFrame:
    """Leaders with the answers of merged pairs appended in order."""
    more = log.where("action = 'MERGED'").groupBy("leader").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "answer"))), lambda x: x["answer"]).alias("more"))
    lead = state.where("id = leader").select(F.col("id").alias("idx")).join(qa, "idx").join(more.withColumnRenamed("leader", "idx"), "idx", "left")
    answer = F.concat(F.col("answer"), F.coalesce(F.array_join(F.transform("more", lambda x: F.concat(F.lit("\n\n[MERGED]: "), x)), ""), F.lit("")))
    return lead.withColumn("answer", answer).drop("more")


def online(nodes: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Accept a pair unless an accepted earlier one is near in question or answer (edges lo, hi).

    id, status: accepted, question (blocked by it, checked first) or answer.
    """
    state = leaders(nodes, questions.select("lo", "hi").unionByName(answers.select("lo", "hi")))
    accepted = state.where("id = leader").select(F.col("id").alias("lo"))
    by_q = questions.join(accepted, "lo").select(F.col("hi").alias("id")).distinct().withColumn("q", F.lit(True))
    status = F.when(F.col("id") == F.col("leader"), "accepted").when(F.col("q"), "question").otherwise("answer")
    return state.join(by_q, "id", "left").select("id", status.alias("status"))


def stats(status: DataFrame) -> DataFrame:
    """total_seen, accepted, blocked by question and answer, dedup_rate in percent with one decimal."""
    n = lambda s: F.count_if(F.col("status") == s)
    blocked = F.count_if(F.col("status") != "accepted")
    return status.agg(
        F.count("*").alias("total_seen"), n("accepted").alias("accepted"), n("question").alias("blocked_by_question"), n("answer").alias("blocked_by_answer"),
        F.coalesce(F.try_divide(F.bround(1000 * F.try_divide(blocked, F.count("*")), 0), F.lit(10.0)), F.lit(0.0)).alias("dedup_rate"),
    )


def misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts (idx, hash) whose hash the cache (hash, ...) lacks."""
    return texts.join(cache.select("hash"), "hash", "left_anti")


def reused(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.join(cache.dropDuplicates(["hash"]), "hash", "left")
