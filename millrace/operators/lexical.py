"""Lexical search over postings: an equi-join on tokens instead of a comparison of all pairs.

A pair of query and document without a common token scores 0 and is not listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy as spelling
from ..functions import text as tx
from ..sources.shared import kept
from . import spelling as likeness

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Queries and documents of a block: every block of the ones meets every block of the others in a group of its own.
BLOCK = 1 << 15
#: The same where spellings are compared.
FUZZY_BLOCK = 1 << 11, 1 << 14
#: Groups to make at least, by smaller blocks of queries, so that more tasks share the work; and queries of a block then, at least.
GROUPS, FEW = 12, 256
#: Scores are compared after rounding to six decimals, so before it those that lie up to a whole last decimal below may count as equal.
MARGIN = 1.1e-6


def top(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each query with their rank (from 1)."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def shared(queries: DataFrame, docs: DataFrame, items) -> DataFrame:
    """For pairs that share an item: inter, nq, nd (sizes of the intersection and of both sets)."""
    q = queries.select("query_id", items(F.col("query")).alias("s")).select("query_id", F.size("s").alias("nq"), F.explode("s").alias("item"))
    d = docs.select("idx", items(F.col("text")).alias("s")).select("idx", F.size("s").alias("nd"), F.explode("s").alias("item"))
    return q.join(d, "item").groupBy("query_id", "idx").agg(F.count("*").alias("inter"), F.first("nq").alias("nq"), F.first("nd").alias("nd"))


def _postings(items: pa.ChunkedArray, weights: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, weight and item of each entry of two list columns."""
    items, weights = items.combine_chunks(), weights.combine_chunks()
    row = np.repeat(np.arange(len(items)), np.diff(items.offsets.to_numpy()))
    return row, weights.flatten().to_numpy(), items.flatten()


def _block(q: pa.Table, d: pa.Table, k: int, spare: float, score: Callable | None) -> pa.Table:
    """The k best rows of d for each of q, with those that a further spare could raise among them; without a score, by likeness of spelling."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(q) and len(d):
        row, weight, item = _postings(d["items"], d["weights"])
        item = item.dictionary_encode()
        code = item.indices.to_numpy()
        by = np.argsort(code, kind="stable")
        row, weight = row[by], weight[by]
        ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(item.dictionary)))])
        asker, factor, asked = _postings(q["items"], q["weights"])
        asked = pc.index_in(asked, item.dictionary)
        known = asked.is_valid().to_numpy(zero_copy_only=False)
        place = np.arange(len(asker)) - np.searchsorted(asker, asker)  # in its query
        asker, factor, asked, place = asker[known], factor[known], asked.drop_null().to_numpy(), place[known]
        cuts = np.searchsorted(asker, np.arange(len(q) + 1))
        ids, idx, nq, nd = q["query_id"].to_numpy(), d["idx"].to_numpy(), q["n"].to_numpy(), d["n"].to_numpy()
        positive = (weight > 0).all() and (factor > 0).all()

        def terms(i: int) -> list[tuple[int, int, float]]:
            return [(ends[c], ends[c + 1], f) for c, f in zip(asked[cuts[i] : cuts[i + 1]].tolist(), factor[cuts[i] : cuts[i + 1]].tolist())]

        def spelled() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            words = [likeness.Texts(t["items"].combine_chunks()) for t in (q, d)]
            own = lambda i: [(p, c, row[a:b]) for p, c, (a, b, _) in zip(place[cuts[i] : cuts[i + 1]].tolist(), asked[cuts[i] : cuts[i + 1]].tolist(), terms(i))]
            return likeness.nearest(*words, code, ((i, own(i)) for i in np.unique(asker).tolist()), k, spare + MARGIN)

        def scored() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for i in np.unique(asker).tolist():
                spans = terms(i)
                at = np.concatenate([row[a:b] for a, b, _ in spans])
                total = np.bincount(at, np.concatenate([weight[a:b] * f for a, b, f in spans]), len(d))
                met = np.flatnonzero(total if positive else np.bincount(at, minlength=len(d)))
                yield i, met, score(total[met], nq[i], nd[met])

        for i, met, rated in scored() if score else spelled():
            if len(rated) > k:
                keep = rated >= np.partition(rated, len(rated) - k)[len(rated) - k] - spare - MARGIN
                met, rated = met[keep], rated[keep]
            out.append((np.full(len(met), ids[i]), idx[met], rated))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.Table.from_arrays([pa.array(c) for c in cols], names=["query_id", "idx", "score"])


def nearest(queries: DataFrame, docs: DataFrame, k: int, score: Callable | None = lambda total, nq, nd: total, spare: float = 0.0, block: tuple[int, int] | None = None) -> DataFrame:
    """query_id, idx, score for the k best documents of each query at least, among those that share an item with it.

    queries: (query_id, n, items, weights), docs: (idx, n, items, weights), items being distinct; score gets the sum of the products of
    the weights of shared items, the query's n and the documents' (NumPy). All pairs are compared, in blocks of both sides, but only the
    best of a block leave it, with all that lie no more than spare (and what rounding may bring) below its k-th. A table
    moves once for each block of the other.
    """
    sides = []
    rows = [df.count() for df in (queries, docs)]
    n = [max(1, -(-count // size)) for count, size in zip(rows, block or (BLOCK, BLOCK))]
    n[0] = max(n[0], min(-(-GROUPS // n[1]), rows[0] // FEW))
    groups = n[0] * n[1]
    for df, id_, own, other in ((queries, "query_id", 0, 1), (docs, "idx", 1, 0)):
        block = F.pmod(F.xxhash64(id_), F.lit(n[own])).alias(f"b{own}")
        cols = F.col(id_).cast("long").alias(id_), F.col("n").cast("long").alias("n"), "items", "weights"
        met = df.select(block, *cols, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n[other] - 1).cast("long"))).alias(f"b{other}"))
        # More parts than there are groups, though they are small, so that few tasks get two: a comparison costs far more than the move.
        sides.append(met.repartition(max(2 * groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "b0", "b1").groupBy("b0", "b1"))
    return sides[0].cogroup(sides[1]).applyInArrow(lambda q, d: _block(q, d, k, spare, score), "query_id long, idx long, score double")


def nearest_sets(queries: DataFrame, docs: DataFrame, items, k: int, score: Callable | None, spare: float = 0.0, block: tuple[int, int] | None = None) -> DataFrame:
    """nearest() by the sizes of two texts' sets of items and of their intersection."""
    ones = lambda df, id_, text: df.select(id_, items(F.col(text)).alias("items")).select(id_, F.size("items").alias("n"), "items", F.transform("items", lambda x: F.lit(1.0)).alias("weights"))
    return nearest(ones(queries, "query_id", "query"), ones(docs, "idx", "text"), k, score, spare, block)


def jaccard_nearest(queries: DataFrame, docs: DataFrame, items, k: int) -> DataFrame:
    """jaccard(), the k best of each query at least."""
    return nearest_sets(queries, docs, items, k, lambda inter, nq, nd: inter / (nq + nd - inter))


def stemmed_nearest(queries: DataFrame, docs: DataFrame, items, k: int) -> DataFrame:
    """stemmed(), the k best of each query at least."""
    return nearest_sets(queries, docs, items, k, lambda inter, nq, nd: 0.5 * inter / (nq + nd - inter) + 0.5 * inter / max(nq, 1))


def normalized_nearest(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """normalized(), the k best of each query at least: only what the bonus could raise among them is looked into for it."""
    own = nearest_sets(queries, docs, tx.words, k, lambda inter, nq, nd: 0.4 * inter / (nq + nd - inter) + 0.4 * inter / max(nq, 1), 0.2 * 0.2)
    q = queries.select("query_id", tx.normalize(F.col("query")).alias("q"))
    d = docs.select("idx", tx.normalize(F.col("text")).alias("d"))
    bonus = F.when(F.col("d").contains(F.col("q")) | F.col("q").contains(F.col("d")), 0.2).otherwise(0.0)
    return own.join(q, "query_id").join(d, "idx").select("query_id", "idx", (F.col("score") + 0.2 * bonus).alias("score"))


def fuzzy_nearest(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """fuzzy() over ASCII words, the k best of each query at least; blocks are small, as a comparison is dear."""
    words = lambda t: F.sort_array(tx.ascii_words(t))
    few = min(FUZZY_BLOCK[0], max(64, queries.count() // 32))  # few queries go in more blocks, so that more tasks share the work
    return nearest_sets(queries, docs, words, k, None, block=(few, FUZZY_BLOCK[1]))


def jaccard(queries: DataFrame, docs: DataFrame, items) -> DataFrame:
    s = shared(queries, docs, items)
    return s.select("query_id", "idx", (F.col("inter") / (F.col("nq") + F.col("nd") - F.col("inter"))).alias("score"))


def normalized(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """0.4 Jaccard + 0.4 overlap + 0.2 x 0.2 if one normalised text contains the other."""
    s = shared(queries, docs, tx.words)
    q = queries.select("query_id", tx.normalize(F.col("query")).alias("q"))
    d = docs.select("idx", tx.normalize(F.col("text")).alias("d"))
    bonus = F.when(F.col("d").contains(F.col("q")) | F.col("q").contains(F.col("d")), 0.2).otherwise(0.0)
    score = 0.4 * F.col("inter") / (F.col("nq") + F.col("nd") - F.col("inter")) + 0.4 * F.col("inter") / F.greatest("nq", F.lit(1)) + 0.2 * bonus
    return s.join(q, "query_id").join(d, "idx").select("query_id", "idx", score.alias("score"))


def stemmed(queries: DataFrame, docs: DataFrame, items) -> DataFrame:
    """Half Jaccard, half overlap of two texts' stems (items gives a text's distinct stems)."""
    s = shared(queries, docs, items)
    score = 0.5 * F.col("inter") / (F.col("nq") + F.col("nd") - F.col("inter")) + 0.5 * F.col("inter") / F.greatest("nq", F.lit(1))
    return s.select("query_id", "idx", score.alias("score"))


def fuzzy(queries: DataFrame, docs: DataFrame, items=tx.words) -> DataFrame:
    """Best likeness of spelling between the words that two texts share and either's words; pairs without a shared word score 0 and are not listed."""
    pairs = shared(queries, docs, items).select("query_id", "idx")
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "idx", "query_id")  # a comparison costs far more than the move
    q = queries.select("query_id", items(F.col("query")).alias("q"))
    d = docs.select("idx", items(F.col("text")).alias("d"))
    return pairs.join(q, "query_id").join(d, "idx").select("query_id", "idx", spelling.set_ratio(F.col("q"), F.col("d")).alias("score"))


def idf(docs: DataFrame) -> DataFrame:
    """df, idf = ln(N / (1 + df)) and its share of the largest, for each distinct word of the normalised text."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(tx.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    own = df.crossJoin(F.broadcast(n)).withColumn("idf", F.log(F.col("n") / (1 + F.col("df"))))  # one row
    most = own.agg(F.max("idf").alias("max_idf"))
    return own.crossJoin(F.broadcast(most)).select("word", "df", "idf", F.try_divide("idf", "max_idf").alias("norm_idf"))


def _bm25(queries: DataFrame, docs: DataFrame, keep: Column | None) -> tuple[DataFrame, DataFrame]:
    """Tokens of the queries (query_id, token, times, avgdl, idf) and of the documents (idx, token, dl, tf)."""
    terms = docs.select("idx", tx.tokens(F.col("text")).alias("t"))
    post = terms.select("idx", F.size("t").alias("dl"), F.explode("t").alias("token")).groupBy("token", "idx", "dl").agg(F.count("*").alias("tf"))
    size = terms.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    df = post.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))  # one row
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    weights = raw.crossJoin(F.broadcast(mean)).select("token", "avgdl", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    q = queries.select("query_id", F.explode(tx.tokens(F.col("query"))).alias("token"))
    q = q.where(keep) if keep is not None else q
    q = q.groupBy("query_id", "token").agg(F.count("*").alias("times"))
    return q.join(weights, "token"), post


def bm25(queries: DataFrame, docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """Okapi BM25 (a negative idf becomes a quarter of the mean idf); repeated query tokens count again.

    keep: a condition on the column token for query tokens.
    """
    q, post = _bm25(queries, docs, keep)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return q.join(post, "token").groupBy("query_id", "idx").agg(F.sum(part).alias("score"))


def bm25_nearest(queries: DataFrame, docs: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """bm25(), the k best of each query at least."""
    q, post = _bm25(queries, docs, keep)
    mean = docs.agg(F.avg(F.size(tx.tokens(F.col("text")))).alias("avgdl"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    listed = lambda df, id_, weight: df.groupBy(id_).agg(F.collect_list(F.struct("token", weight.alias("w"))).alias("x")).select(id_, F.size("x").alias("n"), F.col("x.token").alias("items"), F.col("x.w").alias("weights"))
    return nearest(kept(listed(q, "query_id", F.col("times") * F.col("idf"))), kept(listed(post.crossJoin(F.broadcast(mean)), "idx", part)), k)  # one row


#: How well a keyword matches as a spelling, by its lemma and by its stem.
EXACT, LEMMA, STEM = 1.0, 0.8, 0.3


def _spelled(forms: DataFrame, posts: DataFrame, text: DataFrame) -> DataFrame:
    """(idx, form, a) for the texts in which a spelling (form) occurs; a tells whether the answer has it.

    A spelling without a space occurs within a word, so it meets the distinct words that have its
    first three characters, and those that hold all of it lead to texts by posts (idx, word, a).
    One with a space needs a word that begins with its last part; only the texts (idx, answer, both) with
    such a word are looked into.
    """
    last = F.element_at(F.split("form", " "), -1)
    spaced = F.contains("form", F.lit(" "))
    bits = forms.select("form", spaced.alias("spaced"), F.when(spaced, last).otherwise(F.col("form")).alias("part")).where("part <> ''")
    bits = bits.withColumn("gram", F.left("part", F.lit(3)))
    inside = F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 2, F.lit(1))), lambda i: F.substring("word", i, F.lit(3)))
    begins = F.array(*(F.left("word", F.lit(n)) for n in (1, 2, 3)))
    grams = posts.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(inside, begins))).alias("gram"))
    met = bits.join(grams, "gram").where(F.when(F.col("spaced"), F.startswith("word", "part")).otherwise(F.contains("word", "part")))
    near = met.select("form", "spaced", "word").join(posts, "word")
    plain = near.where("not spaced").groupBy("idx", "form").agg(F.bool_or("a").alias("a"))
    wide = near.where("spaced").select("idx", "form").distinct().join(text, "idx").where(F.contains("both", "form"))
    return plain.unionByName(wide.select("idx", "form", F.contains("answer", "form").alias("a")))


def keywords(queries: DataFrame, qa: DataFrame, lemma=tx.bare_word, stem=tx.bare_word) -> DataFrame:
    """Keyword retrieval: how well a keyword matches the answer or, if it doesn't, question and answer.

    1.0 if a spelling of it occurs, 0.8 if its lemma does, 0.3 if its stem (or a related one) does;
    lemma and stem are injected column functions. match_count, coverage, idf_score (matched share of
    the keywords' idf over answers; unseen words weigh the most), match_quality (the mean) and matched.
    """
    from ..functions import paths

    words = idf(qa.select("idx", F.col("answer").alias("text")))
    most = words.agg(F.coalesce(F.max("norm_idf"), F.lit(1.0)).alias("most"))
    kw = queries.select("query_id", F.explode(tx.keywords(F.col("query"))).alias("word"))
    kw = kw.join(words.select("word", "norm_idf"), "word", "left").crossJoin(F.broadcast(most))  # one row
    kw = kw.select("query_id", "word", F.coalesce("norm_idf", "most").alias("w"))
    total = kw.groupBy("query_id").agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    every = kw.select("word").distinct()
    both = F.concat_ws(" ", "question", "answer")
    text = qa.select("idx", tx.normalize(F.col("answer")).alias("answer"), tx.normalize(both).alias("both"))
    split = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    word = F.explode(F.transform(split("both"), lambda w: F.struct(w.alias("word"), F.array_contains("own", w).alias("a")))).alias("x")
    posts = kept(text.withColumn("own", split("answer")).select("idx", word).select("idx", "x.word", "x.a"))
    spelled = every.select("word", F.explode(tx.variants(F.col("word"))).alias("form"))
    hits = _spelled(spelled.select("form").distinct(), posts, text).join(spelled, "form").select("word", "idx", "a", F.lit(EXACT).alias("s"))
    # The lemmas of question and answer together are cut at their beginning, so they are not those of the answer and more.
    item = lambda c, a: F.transform(paths.lemmas(c, lemma), lambda x: F.struct(x.alias("item"), F.lit(a).alias("a")))
    own = qa.select("idx", F.explode(F.concat(item(F.col("answer"), True), item(both, False))).alias("x")).select("idx", "x.item", "x.a")
    asked = every.select("word", lemma(F.col("word")).alias("item")).where(F.length("item") > 2)
    hits = hits.unionByName(own.join(asked, "item").select("word", "idx", "a", F.lit(LEMMA).alias("s")))
    asked = every.select("word", F.explode(F.array_union(F.array(stem(F.col("word"))), paths.related_stems(F.col("word"), stem))).alias("item"))
    stemmed = posts.select("idx", stem(F.col("word")).alias("item"), "a")
    hits = hits.unionByName(stemmed.join(asked, "item").select("word", "idx", "a", F.lit(STEM).alias("s")))
    best = hits.groupBy("word", "idx").agg(F.coalesce(F.max(F.when(F.col("a"), F.col("s"))), F.max("s")).alias("s"))
    got = kw.join(best, "word").groupBy("query_id", "idx").agg(
        F.count("*").alias("match_count"), F.sum("w").alias("part"), F.avg("s").alias("match_quality"), F.array_join(F.sort_array(F.collect_list("word")), " ").alias("matched")
    )
    return got.join(total, "query_id").select("query_id", "idx", "match_count", (F.col("match_count") / F.col("n")).alias("coverage"), F.coalesce(F.try_divide("part", "total"), F.lit(0.0)).alias("idf_score"), "match_quality", "matched")


def rerank(queries: DataFrame, qa: DataFrame, found: DataFrame, k: int | None = None) -> DataFrame:
    """Retrieve-then-rerank: .30 idf + .25 + .20 keywords in answer + .10 and .05 Jaccard with question and answer + .05 n-grams + .05 likeness of spelling with the question.

    Sets are compared as 64-bit hashes of their items, made once for each text; the likeness is rounded to six decimals, as
    the search by it lists it. With k, rows that
    can't be among a query's k best are left out before the last signal, the dearest, is looked at.
    """
    from ..functions import sets

    h = lambda items: F.transform(items, lambda x: F.xxhash64(x))
    q = queries.select("query_id", h(tx.keywords(F.col("query"))).alias("kw"), h(tx.words(F.col("query"))).alias("qw"), h(tx.ngrams(F.col("query"))).alias("qg"), tx.ascii_words(F.col("query")).alias("qs"))
    d = qa.select("idx", h(tx.words(F.col("question"))).alias("dq"), h(tx.words(F.col("answer"))).alias("da"), h(tx.ngrams(F.col("question"))).alias("gq"), h(tx.ngrams(F.left("answer", F.lit(500)))).alias("ga"), tx.ascii_words(F.col("question")).alias("ds"))
    both = found.join(q, "query_id").join(d, "idx")
    share = 45 * F.size(F.array_intersect("kw", "da")) / 100 / F.greatest(F.size("kw"), F.lit(1))  # both shares, 0.25 and 0.20
    score = (
        0.30 * F.col("idf_score") + share + 0.10 * sets.jaccard(F.col("qw"), F.col("dq"))
        + 0.05 * sets.jaccard(F.col("qw"), F.col("da")) + 0.05 * F.greatest(sets.jaccard(F.col("qg"), F.col("gq")), sets.jaccard(F.col("qg"), F.col("ga")))
    )
    rated = both.select("query_id", "idx", score.alias("score"))
    if k is not None:
        rated = kept(rated)
        edge = top(rated, k, F.desc("score"), F.asc("idx")).groupBy("query_id").agg(F.min("score").alias("edge"))
        rated = rated.join(edge, "query_id").where(F.col("score") + 0.05 + 1e-5 >= F.col("edge")).drop("edge")
    last = rated.join(q.select("query_id", "qs"), "query_id").join(d.select("idx", "ds"), "idx")
    return last.select("query_id", "idx", (F.col("score") + 0.05 * F.round(spelling.set_ratio(F.col("qs"), F.col("ds")), 6)).alias("score"))


def p95(scored: DataFrame) -> DataFrame:
    """Scores over their query's 95th percentile of positive scores, 1 at most."""
    own = scored.where("score > 0")
    edge = own.groupBy("query_id").agg(F.percentile("score", F.lit(0.95)).alias("p95"), F.percentile("score", F.lit(0.5)).alias("p50"))
    return own.join(edge, "query_id").select("query_id", "idx", F.least(F.lit(1.0), F.col("score") / F.col("p95")).alias("score"), "p50", "p95")
