"""Lexical, vector and fused search of all benchmark texts among all question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import sets
from ..functions import text as tx
from ..operators import fusion, lexical, vector
from ..sources.tables import asked, pairs, table
from . import sql as S

BEST = (F.desc, F.asc)


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _top(df: DataFrame, k: int) -> DataFrame:
    return lexical.top(_six(df), k, F.desc("score"), F.asc("idx"))


def _docs(qa: DataFrame, column: str = "question") -> DataFrame:
    text = F.concat_ws(" ", "question", "answer") if column == "both" else F.col(column)
    return qa.select("idx", text.alias("text"))


LIST = "SELECT query_id, idx, score, rank"


@query(S.with_qa(S.shared("x", S.words), "r AS (SELECT query_id, idx, round(inter / (nq + nd - inter), 6) AS score FROM x)") + f"\n{LIST} FROM ({S.ranked('r', 10)})")
def jaccard_search(spark, sf_dir):
    """Word Jaccard of query and question."""
    return _top(lexical.jaccard(asked(spark, sf_dir), _docs(pairs(spark, sf_dir)), tx.words), 10)


@query(S.with_qa(S.shared("x", S.ngrams), "r AS (SELECT query_id, idx, round(inter / (nq + nd - inter), 6) AS score FROM x)") + f"\n{LIST} FROM ({S.ranked('r', 10)})")
def ngram_search(spark, sf_dir):
    """Character trigram Jaccard of query and question."""
    return _top(lexical.jaccard(asked(spark, sf_dir), _docs(pairs(spark, sf_dir)), tx.ngrams), 10)


NORMALIZED = f"""n AS (SELECT x.query_id, x.idx, round(0.4 * inter / (nq + nd - inter) + 0.4 * inter / greatest(nq, 1) + 0.2 *
  CASE WHEN contains({S.norm('question')}, {S.norm('query')}) OR contains({S.norm('query')}, {S.norm('question')}) THEN 0.2 ELSE 0 END, 6) AS score
  FROM x JOIN qa USING (idx) JOIN ask USING (query_id))"""


@query(S.with_qa(S.shared("x", S.words), NORMALIZED) + f"\n{LIST} FROM ({S.ranked('n', 10)})")
def normalized_search(spark, sf_dir):
    """0.4 Jaccard + 0.4 overlap + substring bonus on normalised texts."""
    return _top(lexical.normalized(asked(spark, sf_dir), _docs(pairs(spark, sf_dir))), 10)


IDF = f"""w AS (SELECT word, count(*) AS df FROM (SELECT unnest({S.words('answer')}) AS word FROM qa) GROUP BY word),
i AS (SELECT word, df, ln((SELECT count(*) FROM qa) / (1 + df)) AS idf FROM w), idf AS (SELECT *, idf / nullif((SELECT max(idf) FROM i), 0) AS norm_idf FROM i)"""


@query(S.with_qa(IDF) + "\nSELECT word, df, round(idf, 6) AS idf, round(norm_idf, 6) AS norm_idf FROM idf")
def doc_freq_idf(spark, sf_dir):
    """Document frequency and idf of each word of the answers."""
    out = lexical.idf(_docs(pairs(spark, sf_dir), "answer"))
    return out.select("word", "df", F.round("idf", 6).alias("idf"), F.round("norm_idf", 6).alias("norm_idf"))


@query(S.with_qa(S.bm25()) + f"\n{LIST} FROM ({S.ranked('bm25', 5)})")
def bm25_search(spark, sf_dir):
    """The five best pairs of each query by BM25 over question and answer."""
    return _top(lexical.bm25(asked(spark, sf_dir), _docs(pairs(spark, sf_dir), "both")), 5)


@query(S.with_qa(S.bm25(docs="SELECT doc_id AS idx, text FROM documents")) + f"\n{LIST} FROM ({S.ranked('bm25', 10)})")
def bm25_documents(spark, sf_dir):
    """The ten best documents of each query by BM25."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    return _top(lexical.bm25(asked(spark, sf_dir), docs), 10)


KEPT = f"length(token) > 2 AND token NOT IN ({S.STOPS})"
P95 = """p AS (SELECT query_id, quantile_cont(score, 0.95) AS p95, quantile_cont(score, 0.5) AS p50 FROM bm25 WHERE score > 0 GROUP BY query_id),
scaled AS (SELECT query_id, idx, round(least(1.0, score / p95), 6) AS score, p50, p95 FROM bm25 JOIN p USING (query_id) WHERE score > 0)"""


def _keyword_bm25(spark, sf_dir):
    keep = (F.length("token") > 2) & ~F.col("token").isin(*tx.STOPWORDS)
    return lexical.p95(_six(lexical.bm25(asked(spark, sf_dir), _docs(pairs(spark, sf_dir), "both"), keep)))


@query(S.with_qa(S.bm25(keep=KEPT), P95) + "\nSELECT query_id, idx, score, round(p50, 5) AS p50, round(p95, 5) AS p95 FROM scaled")
def bm25_p95_norm(spark, sf_dir):
    """BM25 without stopwords, over the 95th percentile."""
    return _six(_keyword_bm25(spark, sf_dir)).withColumns({"p50": F.round("p50", 5), "p95": F.round("p95", 5)})


def _variants_sql() -> str:
    parts = ["[word, replace(word, '-', ''), replace(word, '-', ' ')]"]
    for p in tx.PREFIXES:
        rest = f"substr(word, {len(p) + 1})"
        parts.append(f"CASE WHEN starts_with(word, '{p}') AND length(word) > {len(p)} THEN list_filter(['{p}-' || {rest}, '{p} ' || {rest}, CASE WHEN length({rest}) > 3 THEN {rest} END], lambda v: v IS NOT NULL) ELSE [] END")
    return "list_distinct(flatten([" + ", ".join(parts) + "]))"


KEYWORDS = f"""{IDF}, kw AS (SELECT query_id, word, coalesce(norm_idf, (SELECT max(norm_idf) FROM idf), 1.0) AS weight FROM (SELECT query_id, unnest({S.keywords('query')}) AS word FROM ask) LEFT JOIN idf USING (word)),
total AS (SELECT query_id, sum(weight) AS total, count(*) AS n FROM kw GROUP BY query_id), kwords AS (SELECT DISTINCT word FROM kw), form AS (SELECT word, unnest({_variants_sql()}) AS form FROM kwords),
sides AS (SELECT idx, 'a' AS side, answer AS raw FROM qa UNION ALL SELECT idx, 'b', question || ' ' || answer FROM qa),
khits AS (SELECT DISTINCT word, idx, side, 1.0 AS s FROM form JOIN (SELECT idx, side, {S.norm('raw')} AS body FROM sides) ON contains(body, form)
  UNION ALL SELECT word, idx, side, 0.8 FROM kwords JOIN (SELECT idx, side, unnest({S.lemmas('raw')}) AS item FROM sides) ON item = {S.STEM.format(w='word')} WHERE length(item) > 2
  UNION ALL SELECT word, idx, side, 0.3 FROM kwords JOIN (SELECT idx, side, unnest({S.stems('raw')}) AS item FROM sides) ON item = {S.STEM.format(w='word')} OR (starts_with(word, 'co') AND length(word) > 4 AND item = 'co' || {S.STEM.format(w='substr(word, 3)')})),
kbest AS (SELECT word, idx, coalesce(max(s) FILTER (side = 'a'), max(s) FILTER (side = 'b')) AS s FROM khits GROUP BY word, idx),
kr AS (SELECT query_id, idx, count(*) AS match_count, count(*) / any_value(n) AS coverage, coalesce(sum(weight) / nullif(any_value(total), 0), 0) AS idf_score, avg(s) AS match_quality, string_agg(word, ' ' ORDER BY word) AS matched FROM kw JOIN kbest USING (word) JOIN total USING (query_id) GROUP BY query_id, idx)"""
RATED = "query_id, idx, match_count, round(coverage, 6) AS coverage, round(idf_score, 6) AS idf_score, round(match_quality + 1e-9, 6) AS match_quality"


def _rated(spark, sf_dir):
    out = lexical.keywords(asked(spark, sf_dir), pairs(spark, sf_dir))
    return out.withColumns({"coverage": F.round("coverage", 6), "idf_score": F.round("idf_score", 6), "match_quality": F.round(F.col("match_quality") + 1e-9, 6)})


@query(S.with_qa(KEYWORDS) + f"\nSELECT {RATED}, matched FROM kr")
def keyword_retrieval(spark, sf_dir):
    """Pairs that a keyword of the query matches: as a spelling, by its lemma or by its stem."""
    return _rated(spark, sf_dir)


@query(S.with_qa(KEYWORDS, f"rated AS (SELECT {RATED} FROM kr)") + "\nSELECT * FROM (SELECT query_id, idx, match_quality, idf_score, row_number() OVER (PARTITION BY query_id ORDER BY match_quality DESC, idf_score DESC, idx) AS rank FROM rated) WHERE rank <= 10")
def keyword_order(spark, sf_dir):
    """The ten pairs that match best: by quality, then by idf."""
    out = _rated(spark, sf_dir).select("query_id", "idx", "match_quality", "idf_score")
    return lexical.top(out, 10, F.desc("match_quality"), F.desc("idf_score"), F.asc("idx"))


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


RTR = f"""{S.fuzzy('kfz', 'kr')}, kwq AS (SELECT query_id, {S.keywords('query')} AS kw, {S.words('query')} AS qw, {S.ngrams('query')} AS qg FROM ask),
sets AS (SELECT idx, {S.words('question')} AS dq, {S.words('answer')} AS da, {S.ngrams('question')} AS gq, {S.ngrams('left(answer, 500)')} AS ga FROM qa),
rtr AS (SELECT query_id, idx, round(0.30 * idf_score + 0.45 * len(list_intersect(kw, da)) / greatest(len(kw), 1) + 0.10 * ({_jac('qw', 'dq')}) + 0.05 * ({_jac('qw', 'da')}) + 0.05 * greatest({_jac('qg', 'gq')}, {_jac('qg', 'ga')}) + 0.05 * kfz.score, 6) AS score
  FROM kr JOIN kfz USING (query_id, idx) JOIN kwq USING (query_id) JOIN sets USING (idx))"""


def _rtr(spark, sf_dir, k=None):
    q, qa = asked(spark, sf_dir), pairs(spark, sf_dir)
    return lexical.rerank(q, qa, lexical.keywords(q, qa), k)


@query(S.with_qa(KEYWORDS, RTR) + f"\n{LIST} FROM ({S.ranked('rtr', 10)})")
def rtr_search(spark, sf_dir):
    """Keyword retrieval, reranked by seven signals."""
    return _top(_rtr(spark, sf_dir, 10), 10)


@query(
    S.with_qa(f"p AS (SELECT idx, {S.norm('question')} AS a, {S.norm('answer')} AS b, {S.words('question')} AS wa, {S.words('answer')} AS wb, {S.ngrams('question')} AS ga, {S.ngrams('answer')} AS gb FROM qa)")
    + f"\nSELECT idx, a = b AS equal, round(len(list_intersect(wa, wb)) / greatest(len(wa), 1), 6) AS overlap, round({_jac('wa', 'wb')}, 6) AS jaccard, round({_jac('ga', 'gb')}, 6) AS ngram FROM p"
)
def pair_analysis(spark, sf_dir):
    """How alike a question and its answer are."""
    q, a = F.col("question"), F.col("answer")
    rows = pairs(spark, sf_dir)
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "idx")  # a comparison costs far more than the move
    return rows.select(
        "idx", (tx.normalize(q) == tx.normalize(a)).alias("equal"), F.round(sets.overlap(tx.words(q), tx.words(a)), 6).alias("overlap"),
        F.round(sets.jaccard(tx.words(q), tx.words(a)), 6).alias("jaccard"), F.round(sets.jaccard(tx.ngrams(q), tx.ngrams(a)), 6).alias("ngram"),
    )


# vectors ---------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"), "label")
    return rows, rows.where("idx % 50 = 0").select(F.col("idx").alias("query_id"), "vec")


COS = f"""e AS (SELECT vec_id AS idx, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), asked AS (SELECT idx AS query_id, v FROM e WHERE idx % 50 = 0),
c AS (SELECT query_id, idx, {S.cosine('asked.v', 'e.v')} AS score, label FROM asked, e)"""


@query(f"WITH {COS}\n{LIST} FROM ({S.ranked('c', 10)})")
def cosine_topk(spark, sf_dir):
    """Ten nearest of all vectors, for every vector whose id is divisible by 50."""
    rows, q = _vectors(spark, sf_dir)
    return vector.search(q, rows, 10)


@query(f"WITH {COS}\n{LIST} FROM ({S.ranked('(SELECT * FROM c WHERE score >= 0.3)', 1)})")
def topic_search(spark, sf_dir):
    """The nearest vector if its cosine is 0.3 or more."""
    rows, q = _vectors(spark, sf_dir)
    return vector.search(q, rows, 1, least=0.3)


@query(f"WITH {COS}, f AS (SELECT query_id, idx, score FROM c WHERE label = (SELECT min(label) FROM embeddings))\n{LIST} FROM ({S.ranked('f', 10)})")
def filtered_semantic(spark, sf_dir):
    """Nearest vectors among those that a filter leaves (the smallest label)."""
    rows, q = _vectors(spark, sf_dir)
    least = rows.agg(F.min("label").alias("least"))
    return vector.search(q, rows.join(F.broadcast(least), rows.label == least.least, "left_semi"), 10)  # one row


@query(f"WITH {COS}\nSELECT query_id, idx, round_even(score, 3) AS score FROM ({S.ranked('(SELECT * FROM c WHERE score >= 0.35 AND query_id <> idx)', 30)})")
def context_lookup(spark, sf_dir):
    """Up to 30 other vectors from 0.35 on (no two lie as near as the default 0.5), with three decimals."""
    rows, q = _vectors(spark, sf_dir)
    near = vector.search(q, rows, None, least=0.35).where("query_id <> idx")
    return lexical.top(near, 30, F.desc("score"), F.asc("idx")).select("query_id", "idx", F.bround("score", 3).alias("score"))


def _semantic(spark, sf_dir, column, k=None):
    q = asked(spark, sf_dir).select("query_id", vector.encode(F.col("query")).alias("vec"))
    rows = pairs(spark, sf_dir).select("idx", vector.encode(F.col(column)).alias("vec"))
    return vector.search(q, rows, k)


SEMANTIC_Q, SEMANTIC_A = S.semantic("sq", "question"), S.semantic("sa", "answer")
SWITCH = """best AS (SELECT query_id, max(mq) AS mq, max(ma) AS ma FROM (SELECT query_id, max(score) AS mq, NULL AS ma FROM sq GROUP BY query_id UNION ALL SELECT query_id, NULL, max(score) FROM sa GROUP BY query_id) GROUP BY query_id),
sw AS (SELECT query_id, idx, score, 'question' AS side FROM sq JOIN best USING (query_id) WHERE NOT coalesce(ma > mq, false) UNION ALL SELECT query_id, idx, score, 'answer' FROM sa JOIN best USING (query_id) WHERE ma > mq)"""


@query(S.with_qa(SEMANTIC_Q, SEMANTIC_A, SWITCH) + f"\n{LIST}, side FROM ({S.ranked('sw', 1)})")
def answer_vs_question_switch(spark, sf_dir):
    """The nearest pair by question, or by answer where the nearest answer is nearer."""
    q, a = (_semantic(spark, sf_dir, c, 1).withColumn("side", F.lit(c)) for c in ("question", "answer"))
    return lexical.top(q.unionByName(a).drop("rank"), 1, F.desc("score"), F.desc("side"), F.asc("idx"))


# fusion ----------------------------------------------------------------------------------------------

HYBRID = "m AS (SELECT query_id, max(score) AS m FROM bm25 GROUP BY query_id), lx AS (SELECT query_id, idx, score / m AS lex FROM bm25 JOIN m USING (query_id))"


def _hybrid_sql(alpha: float, sem: str) -> str:
    return f"""h AS (SELECT query_id, idx, coalesce({sem}.score, 0) AS sem, coalesce(lex, 0) AS lex, round({alpha} * coalesce({sem}.score, 0) + {1 - alpha:.2f} * coalesce(lex, 0), 6) AS score FROM {sem} FULL JOIN lx USING (query_id, idx))"""


@query(S.with_qa(S.bm25(), SEMANTIC_Q, HYBRID, _hybrid_sql(0.85, "sq")) + f"\n{LIST}, CASE WHEN 0.85 * sem >= 0.15 * lex THEN 'semantic' ELSE 'lexical' END AS dominant FROM ({S.ranked('h', 10)})")
def hybrid_search(spark, sf_dir):
    """0.85 semantic + 0.15 BM25."""
    lex = _six(lexical.bm25(asked(spark, sf_dir), _docs(pairs(spark, sf_dir), "both")))
    out = fusion.hybrid(_semantic(spark, sf_dir, "question"), lex, 0.85)
    return _top(out, 10).select("query_id", "idx", "score", "rank", "dominant")


def _four(spark, sf_dir):
    q, qa = asked(spark, sf_dir), pairs(spark, sf_dir)
    lex = _top(lexical.bm25(q, _docs(qa, "both")), 20)
    sem_q, sem_a = _semantic(spark, sf_dir, "question", 20), _semantic(spark, sf_dir, "answer", 20)
    first = sem_q.where("score >= 0.3")  # stands for the retriever that filters first
    return fusion.lists(filtered_semantic=first, bm25=lex, question_semantic=sem_q, answer_semantic=sem_a)


FOUR = f"""four AS (SELECT query_id, 'filtered_semantic' AS retriever, idx, rank FROM ({S.ranked('sq', 20)}) WHERE score >= 0.3 UNION ALL SELECT query_id, 'bm25', idx, rank FROM ({S.ranked('bm25', 20)})
UNION ALL SELECT query_id, 'question_semantic', idx, rank FROM ({S.ranked('sq', 20)}) UNION ALL SELECT query_id, 'answer_semantic', idx, rank FROM ({S.ranked('sa', 20)})),
fused AS (SELECT query_id, idx, round(sum(CASE retriever WHEN 'filtered_semantic' THEN 1.5 WHEN 'bm25' THEN 1.0 WHEN 'question_semantic' THEN 1.2 ELSE 0.8 END / (60 + rank)), 6) AS score, count(*) AS votes, string_agg(retriever, ',' ORDER BY retriever) AS sources FROM four GROUP BY query_id, idx)"""


@query(S.with_qa(S.bm25(), SEMANTIC_Q, SEMANTIC_A, FOUR) + f"\n{LIST}, votes, sources, score >= 0.02 AS answered FROM ({S.ranked('fused', 30)})")
def rrf_weighted(spark, sf_dir):
    """Weighted reciprocal rank fusion of four retrievers; below 0.02 nothing is answered."""
    return fusion.floor(_top(fusion.rrf(_four(spark, sf_dir), fusion.WEIGHTS), 30))


ZERO = f"""two AS (SELECT query_id, idx, rank FROM ({S.ranked('n', 20)}) UNION ALL SELECT query_id, idx, rank FROM ({S.ranked('sq', 20)})),
z AS (SELECT query_id, idx, round(sum(1.0 / (60 + rank - 1)), 6) AS score FROM two GROUP BY ALL)"""


@query(S.with_qa(S.shared("x", S.words), NORMALIZED, SEMANTIC_Q, ZERO) + "\nSELECT * FROM (SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx DESC) AS rank FROM z) WHERE rank <= 10")
def rrf_zero_based(spark, sf_dir):
    """Unweighted fusion of two lists with ranks from 0; ties by descending index."""
    lex = _top(lexical.normalized(asked(spark, sf_dir), _docs(pairs(spark, sf_dir))), 20)
    both = fusion.lists(lexical=lex, semantic=_semantic(spark, sf_dir, "question", 20))
    out = _six(fusion.rrf(both, shift=1)).select("query_id", "idx", "score")
    return lexical.top(out, 10, F.desc("score"), F.desc("idx"))


#: Rows of each list that are merged.
LISTED, RERANKED = 100, 2000


def _seven(spark, sf_dir):
    q, qa = asked(spark, sf_dir), pairs(spark, sf_dir)
    docs, cut = _docs(qa), lambda df, k=LISTED: _top(df, k).drop("rank")
    combined = vector.search(q.select("query_id", vector.encode(F.col("query")).alias("vec")), qa.select("idx", vector.encode(F.concat_ws(" ", "question", "answer")).alias("vec")), LISTED)
    own = {
        "rtr": cut(_rtr(spark, sf_dir, RERANKED), RERANKED), "bm25": _six(_keyword_bm25(spark, sf_dir)), "norm": cut(lexical.normalized_nearest(q, docs, LISTED)),
        "stem": cut(lexical.stemmed_nearest(q, docs, tx.stem_words, LISTED)), "fuzz": cut(lexical.fuzzy_nearest(q, docs, LISTED)), "cos": combined, "ngram": cut(lexical.jaccard_nearest(q, docs, tx.ngrams, LISTED)),
    }
    long = None
    for name, df in own.items():
        part = df.select("query_id", "idx", F.lit(name).alias("method"), "score")
        long = part if long is None else long.unionByName(part)
    value = lambda n: F.coalesce(F.max(F.when(F.col("method") == n, F.col("score"))), F.lit(0.0)).alias(n)
    return long.groupBy("query_id", "idx").agg(*(value(n) for n in own))


SEVEN_OWN = ("rtr", "cos", "bm25", "norm", "stem", "fuzz", "ngram")
SEVEN = f"""yr AS (SELECT query_id, idx, round(inter / (nq + nd - inter), 6) AS score FROM y), st AS (SELECT query_id, idx, round(0.5 * inter / (nq + nd - inter) + 0.5 * inter / greatest(nq, 1), 6) AS score FROM stw),
long AS (SELECT query_id, idx, 'rtr' AS m, score FROM ({S.ranked('rtr', RERANKED)}) UNION ALL SELECT query_id, idx, 'bm25', score FROM scaled UNION ALL SELECT query_id, idx, 'norm', score FROM ({S.ranked('n', LISTED)})
  UNION ALL SELECT query_id, idx, 'stem', score FROM ({S.ranked('st', LISTED)}) UNION ALL SELECT query_id, idx, 'fuzz', score FROM ({S.ranked('fz', LISTED)})
  UNION ALL SELECT query_id, idx, 'cos', score FROM ({S.ranked('sb', LISTED)}) UNION ALL SELECT query_id, idx, 'ngram', score FROM ({S.ranked('yr', LISTED)})),
seven AS (SELECT query_id, idx, """ + ", ".join(f"coalesce(max(score) FILTER (m = '{m}'), 0) AS {m}" for m in SEVEN_OWN) + """ FROM long GROUP BY query_id, idx),
fam AS (SELECT *, greatest(rtr, bm25) AS kw, greatest(norm, stem, fuzz) AS txt, cos AS sem FROM seven WHERE """ + " + ".join(f"({m} > 0)::INT" for m in SEVEN_OWN) + """ >= 2),
eight AS (SELECT query_id, idx, round((rtr + cos + bm25 + norm + stem + fuzz + ngram) / 7 + 1e-9, 6) AS avg, round((rtr + cos + bm25 + norm + stem + fuzz) / 6 + 1e-9, 6) AS avg6, round((kw + txt + sem) / 3 + 1e-9, 6) AS fam_avg, round(0.5 * kw + 0.3 * txt + 0.2 * sem + 1e-9, 6) AS fam_wt,
  round(CASE WHEN kw = 0 THEN 0.3 * txt + 0.2 * sem ELSE 0.5 * kw + 0.3 * txt + 0.2 * sem END + 1e-9, 6) AS kw_pen, round(CASE WHEN kw > 0 AND txt > 0 AND sem > 0 THEN pow(kw * txt * sem, 1.0 / 3) ELSE 0 END + 1e-9, 6) AS geo,
  round(0.6 * rtr + 0.2 * txt + 0.2 * sem + 1e-9, 6) AS rtr_dom, round(CASE WHEN kw > 0 AND txt > 0 AND sem > 0 THEN 3 / (1 / kw + 1 / txt + 1 / sem) ELSE 0 END + 1e-9, 6) AS harm FROM fam)"""
ALL_SEVEN = (KEYWORDS, RTR, S.bm25(keep=KEPT), P95, S.shared("x", S.words), NORMALIZED, S.shared("y", S.ngrams), S.shared("stw", S.stems), S.shared("xa", S.ascii_words), S.fuzzy("fz", "xa"), S.semantic("sb", "question || ' ' || answer"), SEVEN)


def _eight(spark, sf_dir):
    out = fusion.families(_seven(spark, sf_dir))
    return out.select("query_id", "idx", *(F.round(F.col(m) + 1e-9, 6).alias(m) for m in fusion.METHODS))


@query(S.with_qa(*ALL_SEVEN) + "\nSELECT * FROM eight")
def family_fusion(spark, sf_dir):
    """Seven algorithms merged in eight ways, for pairs that two agree on."""
    return _eight(spark, sf_dir)


@query(
    S.with_qa(*ALL_SEVEN, "l AS (" + " UNION ALL ".join(f"SELECT query_id, idx, '{m}' AS method, {m} AS score FROM eight" for m in fusion.METHODS) + ")")
    + "\nSELECT query_id, method, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, idx) AS r FROM l) WHERE r = 1"
)
def best_per_method(spark, sf_dir):
    """The first pair under each of the eight ways."""
    return fusion.best_each(_eight(spark, sf_dir))


@query(
    S.with_qa(
        S.bm25(), SEMANTIC_Q, HYBRID, _hybrid_sql(0.85, "sq"),
        f"h1 AS ({S.ranked('h', 10)}), s1 AS ({S.ranked('sq', 10)})",
        "pool AS (SELECT query_id, 1 AS stage, 'semantic' AS source, idx, score FROM s1 WHERE score >= 0.5 UNION ALL SELECT query_id, 2, 'rephrased', idx, score FROM h1 WHERE score >= 0.5)",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stage, idx) AS r FROM pool) WHERE r = 1)",
    )
    + "\nSELECT query_id, coalesce(source, 'fallback') AS source, idx, score FROM ask LEFT JOIN best USING (query_id)"
)
def cascade_v1(spark, sf_dir):
    """Semantic, then hybrid candidates; the best that reaches its threshold, else a fallback row."""
    q = asked(spark, sf_dir)
    lex = _six(lexical.bm25(q, _docs(pairs(spark, sf_dir), "both")))
    sem = _semantic(spark, sf_dir, "question")
    first = _top(sem, 10)
    second = _top(fusion.hybrid(sem, lex, 0.85), 10)
    return fusion.cascade([(1, "semantic", first, 0.5), (2, "rephrased", second, 0.5)], q)


@query(
    S.with_qa(
        S.bm25(), SEMANTIC_Q, SEMANTIC_A, HYBRID, _hybrid_sql(0.85, "sq"),
        "sx AS (SELECT query_id, idx, max(score) AS score FROM (SELECT * FROM sq UNION ALL SELECT * FROM sa) GROUP BY query_id, idx)",
        _hybrid_sql(0.5, "sx").replace("h AS", "g AS", 1),
        f"h1 AS ({S.ranked('h', 10)}), s1 AS ({S.ranked('sq', 10)}), g1 AS ({S.ranked('g', 1)})",
        "pool AS (SELECT query_id, 1 AS stage, 'semantic' AS source, idx, score FROM s1 WHERE score >= 0.5 UNION ALL SELECT query_id, 2, 'rephrased', idx, score FROM h1 WHERE score >= 0.5 UNION ALL SELECT query_id, 3, 'answer', idx, score FROM g1 WHERE score >= 0.4)",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stage, idx) AS r FROM pool) WHERE r = 1)",
    )
    + "\nSELECT query_id, coalesce(source, 'fallback') AS source, idx, score FROM ask LEFT JOIN best USING (query_id)"
)
def cascade_v1_answers(spark, sf_dir):
    """cascade_v1 with its third stage: hybrid (alpha 0.5) over the nearer of question and answer, the first from 0.4 on."""
    q = asked(spark, sf_dir)
    lex = _six(lexical.bm25(q, _docs(pairs(spark, sf_dir), "both")))
    sem = _semantic(spark, sf_dir, "question")
    nearer = sem.unionByName(_semantic(spark, sf_dir, "answer")).groupBy("query_id", "idx").agg(F.max("score").alias("score"))
    first = _top(sem, 10)
    second = _top(fusion.hybrid(sem, lex, 0.85), 10)
    third = _top(fusion.hybrid(nearer, lex, 0.5), 1)
    return fusion.cascade([(1, "semantic", first, 0.5), (2, "rephrased", second, 0.5), (3, "answer", third, 0.4)], q)


@query(
    S.with_qa(S.bm25(), SEMANTIC_Q, SEMANTIC_A, FOUR, f"top AS ({S.ranked('fused', 1)})")
    + "\nSELECT query_id, CASE WHEN score >= 0.02 THEN 'answer' ELSE 'fallback' END AS source, CASE WHEN score >= 0.02 THEN idx END AS idx, score FROM ask LEFT JOIN top USING (query_id)"
)
def cascade_v2(spark, sf_dir):
    """Four retrievers, fused; the first is the answer from 0.02 on."""
    best = _top(fusion.rrf(_four(spark, sf_dir), fusion.WEIGHTS), 1)
    ok = F.col("score") >= 0.02
    return asked(spark, sf_dir).select("query_id").join(best, "query_id", "left").select("query_id", F.when(ok, "answer").otherwise("fallback").alias("source"), F.when(ok, F.col("idx")).alias("idx"), "score")
