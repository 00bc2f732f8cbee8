"""Knowledge base, near-duplicates, edits, evaluation, streams and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import text as tx
from ..operators import dedup, edits, lexical, vector
from ..sources.shared import folder, kept
from ..sources.tables import QA_SQL, pairs, table, topics
from ..streaming import progress
from . import sql as S

QA = "WITH " + QA_SQL + "\n"


# knowledge base --------------------------------------------------------------------------------------


@query(QA + "SELECT * FROM qa")
def kb_pairs(spark, sf_dir):
    """Flattened question-answer pairs."""
    return pairs(spark, sf_dir)


@query(QA + "SELECT topic_index, topic, count(*) AS qa_count, string_agg(question, ' | ' ORDER BY qa_index) AS questions FROM qa GROUP BY ALL")
def kb_topics(spark, sf_dir):
    """Topics with their nested questions in order."""
    return topics(pairs(spark, sf_dir)).select("topic_index", "topic", F.size("qa_pairs").cast("long").alias("qa_count"), F.array_join(F.transform("qa_pairs", lambda x: x["question"]), " | ").alias("questions"))


@query(QA + "SELECT idx, topic, question FROM qa WHERE contains(lower(question), 'the') OR contains(lower(answer), 'the')")
def keyword_filter(spark, sf_dir):
    """Pairs with a keyword in question or answer, in any case."""
    has = lambda c: F.lower(c).contains("the")
    return pairs(spark, sf_dir).where(has("question") | has("answer")).select("idx", "topic", "question")


@query(QA + ", c AS (SELECT topic, count(*) AS qa_count, avg(length(answer)) AS mean FROM qa GROUP BY topic)\nSELECT topic, qa_count, round(mean, 6) AS mean_answer FROM c".replace("\n, c", ", c"))
def topic_summary(spark, sf_dir):
    """Pairs and mean answer length of each topic."""
    return pairs(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("qa_count"), F.round(F.avg(F.length("answer")), 6).alias("mean_answer"))


@query(f"SELECT doc_id, md5({S.norm('text')}) AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    """Digest of each document's normalised text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("normalized"))


@query(
    rf"""SELECT doc_id, len({S.tokens('text')}) AS words, length(text) AS chars, greatest(1, len({S.tokens('text')}) // 200) AS minutes, greatest(3, least(5, length(text) // 1000)) AS wanted,
  CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents"""
)
def content_metadata(spark, sf_dir):
    """Words, characters, reading time, wanted questions and a preview of each document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(t)).alias("words"), F.length(t).alias("chars"), tx.read_minutes(t).alias("minutes"), tx.pairs_wanted(t).alias("wanted"), tx.preview(t).alias("preview"))


CUT_SQL = r"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '(?i)Skip to content|Skip to main content|Skip navigation|Share this page|Print this page|Email this page|JavaScript must be enabled|Enable JavaScript', '', 'g')) AS s FROM documents),
h AS (SELECT doc_id, s, left(s, 4000) AS h, length(left(s, 4000)) - instr(reverse(left(s, 4000)), '.') + 1 AS stop FROM s)
SELECT doc_id, md5(CASE WHEN length(s) <= 4000 THEN s WHEN contains(h, '.') AND stop - 1 > 3000 THEN left(h, stop) ELSE h END) AS content FROM h"""


@query(CUT_SQL)
def cut_content(spark, sf_dir):
    """Digest of each document's cleaned text, cut at a sentence below 4000 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.cut_content(F.col("text"))).alias("content"))


# near-duplicates --------------------------------------------------------------------------------------

VECTORS = f"""e AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT a.idx AS lo, b.idx AS hi, {S.cosine('a.v', 'b.v')} AS score FROM e a JOIN e b ON a.idx < b.idx WHERE {S.cosine('a.v', 'b.v')} >= 0.35)"""


def _near(spark, sf_dir, least=0.35):
    """All links among the vectors: queries go in blocks against all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    found = vector.search(rows.select(F.col("idx").alias("query_id"), "vec"), rows, None, least=least)
    return found.where("query_id < idx").select(F.col("query_id").alias("lo"), F.col("idx").alias("hi"), "score")


@query(f"WITH {VECTORS}\nSELECT lo, hi, score FROM near")
def similar_pairs(spark, sf_dir):
    """Pairs of vectors from 0.35 on (at the default of 0.9 there are none)."""
    return _near(spark, sf_dir)


#: The scan itself: one vector at a time against the leaders so far.
SCAN = f"""WITH RECURSIVE {VECTORS}, o AS (SELECT idx, row_number() OVER (ORDER BY idx) AS k, coalesce(adj, []) AS adj FROM e LEFT JOIN (SELECT hi, list(lo) AS adj FROM near WHERE score >= LEAST_SCORE GROUP BY hi) x ON x.hi = e.idx),
scan AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leads UNION ALL SELECT o.k, CASE WHEN len(list_intersect(o.adj, scan.leads)) = 0 THEN list_append(scan.leads, o.idx) ELSE scan.leads END FROM scan JOIN o ON o.k = scan.k + 1),
leads AS (SELECT max_by(leads, k) AS leads FROM scan),
lead_of AS (SELECT idx AS id, CASE WHEN list_contains(leads, idx) THEN idx ELSE list_min(list_intersect(adj, leads)) END AS leader FROM o, leads)"""
ONLINE = SCAN.replace("LEAST_SCORE", "0.36") + """,
status AS (SELECT id, CASE WHEN id = leader THEN 'accepted' WHEN EXISTS (SELECT 1 FROM near n JOIN lead_of l ON l.id = n.lo AND l.leader = l.id WHERE n.hi = lead_of.id AND n.score >= 0.40) THEN 'question' ELSE 'answer' END AS status FROM lead_of)"""


@query(SCAN.replace("LEAST_SCORE", "0.35") + "\nSELECT id, leader FROM lead_of")
def greedy_dedup(spark, sf_dir):
    """Leader of each vector in a scan in id order, at 0.35."""
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return dedup.leaders(nodes, _near(spark, sf_dir))


@query(ONLINE + "\nSELECT id, status FROM status")
def online_dedup(spark, sf_dir):
    """Arrival-order acceptance: questions' links from 0.40, answers' from 0.36 on."""
    nodes, near = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), kept(_near(spark, sf_dir))
    return dedup.online(nodes, near.where("score >= 0.40"), near.where("score >= 0.36"))


@query(
    ONLINE
    + "\nSELECT count(*) AS total_seen, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'question') AS blocked_by_question, count(*) FILTER (status = 'answer') AS blocked_by_answer, round_even(1000.0 * count(*) FILTER (status <> 'accepted') / count(*), 0) / 10.0 AS dedup_rate FROM status"
)
def dedup_stats(spark, sf_dir):
    """Counters of the arrival-order run."""
    return dedup.stats(online_dedup(spark, sf_dir))


@query(
    """WITH h AS (SELECT doc_id, md5(text) AS hash FROM documents), c AS (SELECT DISTINCT md5(text) AS hash FROM documents WHERE doc_id % 2 = 0)
SELECT h.doc_id, h.hash, c.hash IS NOT NULL AS cached FROM h LEFT JOIN c USING (hash)"""
)
def cache_reuse(spark, sf_dir):
    """Documents whose text a cache (of every even document) knows by hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    cache = docs.where("doc_id % 2 = 0").select("hash", F.lit(True).alias("known"))
    return dedup.reused(docs, cache).select("doc_id", "hash", F.coalesce("known", F.lit(False)).alias("cached"))


@query("SELECT doc_id, md5(text) AS hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def cache_misses(spark, sf_dir):
    """Documents that have to be encoded anew."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    return dedup.misses(docs, docs.where("doc_id % 2 = 0")).select("doc_id", "hash")


@query(
    QA + ", now AS (SELECT topic || '_' || topic_index || '_' || qa_index AS key, md5(question || '|' || answer || '|' || topic) AS hash, qa_index FROM qa)\nSELECT key, hash, qa_index % 3 <> 0 AS reused FROM now"
)
def metadata_reuse(spark, sf_dir):
    """Pairs whose key and hash an earlier run knows (there, every third pair of a topic was other)."""
    now = pairs(spark, sf_dir).select(F.concat_ws("_", "topic", "topic_index", "qa_index").alias("key"), F.md5(F.concat_ws("|", "question", "answer", "topic")).alias("hash"), "qa_index")
    old = now.select("key", F.when(F.col("qa_index") % 3 == 0, F.lit("")).otherwise(F.col("hash")).alias("hash"), F.lit(True).alias("known"))
    return now.join(old, ["key", "hash"], "left").select("key", "hash", F.coalesce("known", F.lit(False)).alias("reused"))


# edits ------------------------------------------------------------------------------------------------


def _flat(topics_):
    return topics_.select("topic_index", F.posexplode("qa_pairs").alias("at", "p")).select("topic_index", "at", "p.question", "p.answer")


PLACE = "row_number() OVER (PARTITION BY topic_index ORDER BY qa_index) - 1"


@query(QA + "SELECT topic_index, qa_index AS at, CASE WHEN topic_index = 2 AND qa_index = 0 THEN 'new question' ELSE question END AS question, CASE WHEN topic_index = 2 AND qa_index = 0 THEN 'new answer' ELSE answer END AS answer FROM qa")
def edit_pair(spark, sf_dir):
    """One pair's texts replaced."""
    return _flat(edits.edit(topics(pairs(spark, sf_dir)), 2, 0, "new question", "new answer"))


@query(QA + f"SELECT topic_index, CAST({PLACE} AS INTEGER) AS at, question, answer FROM qa WHERE qa_index <> 0")
def delete_pairs(spark, sf_dir):
    """The first pair of every topic dropped, and topics that this empties."""
    return _flat(edits.delete(topics(pairs(spark, sf_dir)), F.lit(True), F.array(F.lit(0))))


@query(QA + ", m AS (SELECT topic_index, string_agg(question, ' ' ORDER BY qa_index) AS q, string_agg(answer, ' ' ORDER BY qa_index) AS a, count(*) AS n FROM qa GROUP BY topic_index)\nSELECT topic_index, qa_index AS at, question, answer FROM qa UNION ALL SELECT topic_index, CAST(n AS INTEGER), q, a FROM m")
def append_merged(spark, sf_dir):
    """A merged pair (texts joined by a space) added to every topic."""
    both = lambda f: edits.merged_text(F.transform("qa_pairs", lambda x: x[f]))
    pair = F.struct(F.size("qa_pairs").alias("qa_index"), both("question").alias("question"), both("answer").alias("answer"))
    return _flat(edits.append(topics(pairs(spark, sf_dir)), pair))


@query(QA + "SELECT topic_index, qa_index AS at, CASE WHEN qa_index % 2 = 1 THEN question || '?' ELSE question END AS question, answer FROM qa")
def replace_selected(spark, sf_dir):
    """Every second pair's question replaced."""
    change = lambda x, i: F.when(i % 2 == 1, x.withField("question", F.concat(x["question"], F.lit("?")))).otherwise(x)
    return _flat(edits.replace(topics(pairs(spark, sf_dir)), change))


def _replies(spark, sf_dir):
    """Replies of a language service, made from the pairs of a topic."""
    line = lambda n: F.concat(F.lit("Q: "), F.regexp_replace("question", "\n", " "))
    body = F.concat_ws("\n", F.concat(F.lit("BUCKET_"), F.col("qa_index") + 1, F.lit(":")), line(0), F.concat(F.lit("ANSWER: "), F.regexp_replace("answer", "\n", " ")))
    rows = pairs(spark, sf_dir).select("topic_index", F.struct("qa_index", body.alias("t")).alias("x"))
    return rows.groupBy(F.col("topic_index").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


@query(QA + r"SELECT topic_index AS id, 'bucket_' || (qa_index + 1) AS bucket_id, 0 AS q_index, trim(replace(question, chr(10), ' ')) AS question, trim(replace(answer, chr(10), ' ')) AS answer FROM qa WHERE trim(question) <> '' AND trim(answer) <> ''")
def bucket_parse(spark, sf_dir):
    """Buckets of questions with a shared answer, parsed from replies."""
    return edits.buckets(_replies(spark, sf_dir))


@query(QA + ", q AS (SELECT topic_index AS id, list(trim(replace(question, chr(10), ' ')) ORDER BY qa_index) AS q, arg_max(trim(replace(answer, chr(10), ' ')), qa_index) AS answer FROM qa GROUP BY topic_index)\nSELECT id, list_aggregate(list_transform(range(1, 11), lambda i: q[least(i, len(q))]), 'string_agg', ' | ') AS questions, answer FROM q")
def unified_parse(spark, sf_dir):
    """Ten questions that share one answer, parsed from replies."""
    qa = pairs(spark, sf_dir)
    ask = F.concat(F.lit("Q"), F.col("qa_index") + 1, F.lit(": "), F.regexp_replace("question", "\n", " "))
    rows = qa.groupBy(F.col("topic_index").alias("id")).agg(F.sort_array(F.collect_list(F.struct("qa_index", ask.alias("t")))).alias("x"), F.max_by("answer", "qa_index").alias("a"))
    text = F.concat(F.array_join(F.transform("x", lambda x: x["t"]), "\n"), F.lit("\nUNIFIED_ANSWER: "), F.regexp_replace("a", "\n", " "))
    out = edits.unified(rows.select("id", text.alias("text")))
    return out.select("id", F.array_join("questions", " | ").alias("questions"), "answer")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def conversation_history(spark, sf_dir):
    """Turns of each conversation in order."""
    chat = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.max_by("text", "turn").alias("last_text"))
    return chat.select("conv_id", "turns", F.array_join(F.transform("x", lambda x: x["role"]), ",").alias("roles"), "last_text")


# evaluation --------------------------------------------------------------------------------------------

CASES = """cases AS (SELECT idx AS query_id, regexp_replace(question, '^(\\S+\\s+){1,3}', '') AS query FROM qa)"""


def _cases(spark, sf_dir):
    """Every question, rephrased by dropping its first three words."""
    return pairs(spark, sf_dir).select(F.col("idx").alias("query_id"), F.regexp_replace("question", r"^(\S+\s+){1,3}", "").alias("query"))


def _ranked_cases(spark, sf_dir, k=5):
    docs = pairs(spark, sf_dir).select("idx", F.col("question").alias("text"))
    cases = _cases(spark, sf_dir)
    lex = lexical.bm25_nearest(cases, docs, k).withColumn("score", F.round("score", 6))
    jac = lexical.jaccard_nearest(cases, docs, tx.words, k).withColumn("score", F.round("score", 6))
    one = lambda df, name: lexical.top(df, k, F.desc("score"), F.asc("idx")).withColumn("method", F.lit(name))
    return one(lex, "bm25").unionByName(one(jac, "jaccard"))


_ask = S.bm25(docs="SELECT idx, question AS text FROM qa").replace("FROM ask", "FROM cases")
_jac = S.shared("x", S.words).replace("FROM ask", "FROM cases")
RANKED = f"""{CASES}, {_ask}, {_jac}, j AS (SELECT query_id, idx, round(inter / (nq + nd - inter), 6) AS score FROM x),
r AS (SELECT 'bm25' AS method, query_id, idx, score, rank FROM ({S.ranked('bm25', 5)}) UNION ALL SELECT 'jaccard', query_id, idx, score, rank FROM ({S.ranked('j', 5)}))"""


@query(
    S.with_qa(RANKED)
    + """
SELECT method, n, round(100.0 * count(*) FILTER (rank <= 1) / n, 6) AS top1, round(100.0 * count(*) FILTER (rank <= 3) / n, 6) AS top3, round(100.0 * count(*) FILTER (rank <= 5) / n, 6) AS top5
FROM r, (SELECT count(*) AS n FROM cases) WHERE query_id = idx GROUP BY method, n"""
)
def hit_at_k(spark, sf_dir):
    """How often the rephrased question finds its own pair among the first 1, 3 and 5."""
    n = pairs(spark, sf_dir).agg(F.count("*").alias("n"))
    own = _ranked_cases(spark, sf_dir).where("query_id = idx").crossJoin(F.broadcast(n))  # one row
    share = lambda k: F.round(100.0 * F.count_if(F.col("rank") <= k) / F.col("n"), 6).alias(f"top{k}")
    return own.groupBy("method", "n").agg(share(1), share(3), share(5))


@query(
    S.with_qa(RANKED)
    + """
SELECT coalesce(b.hit, false) AS bm25_hit, coalesce(j.hit, false) AS jaccard_hit, count(*) AS n FROM cases LEFT JOIN (SELECT query_id, query_id = idx AS hit FROM r WHERE method = 'bm25' AND rank = 1) b USING (query_id)
LEFT JOIN (SELECT query_id, query_id = idx AS hit FROM r WHERE method = 'jaccard' AND rank = 1) j USING (query_id) GROUP BY ALL"""
)
def winner_crosstab(spark, sf_dir):
    """Which of two methods finds the pair first."""
    first = _ranked_cases(spark, sf_dir).where("rank = 1")
    hit = lambda m: F.coalesce(F.max(F.when(F.col("method") == m, F.col("query_id") == F.col("idx"))), F.lit(False)).alias(f"{m}_hit")
    per = _cases(spark, sf_dir).select("query_id").join(first, "query_id", "left").groupBy("query_id").agg(hit("bm25"), hit("jaccard"))
    return per.groupBy("bm25_hit", "jaccard_hit").agg(F.count("*").alias("n"))


@query(S.with_qa(RANKED) + "\nSELECT method, rank, count(*) AS n, round(min(score), 5) AS least, round(avg(score), 5) AS mean, round(max(score), 5) AS most FROM r GROUP BY method, rank")
def stage_score_stats(spark, sf_dir):
    """Smallest, mean and largest score by method and rank."""
    f = lambda g, n: F.round(g("score"), 5).alias(n)
    return _ranked_cases(spark, sf_dir).groupBy("method", "rank").agg(F.count("*").alias("n"), f(F.min, "least"), f(F.avg, "mean"), f(F.max, "most"))


@query(S.with_qa(RANKED) + "\nSELECT * FROM (SELECT method, query_id, idx, score, row_number() OVER (PARTITION BY method ORDER BY score DESC, query_id) AS place FROM r WHERE rank = 1 AND query_id <> idx) WHERE place <= 10")
def near_misses(spark, sf_dir):
    """The ten surest wrong answers of each method."""
    wrong = _ranked_cases(spark, sf_dir).where("rank = 1 and query_id <> idx").select("method", "query_id", "idx", "score")
    return wrong.withColumn("place", F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "query_id"))).where("place <= 10")


# streams -----------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE), 4) AS total FROM events GROUP BY event_type")
def progress_counts(spark, sf_dir):
    """Running figures by type of event, after all events."""
    out = progress.drained(progress.counts(progress.events(spark, sf_dir)), folder(spark))
    return out.select("event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


@query("SELECT user_id AS worker_id, count(*) AS items, arg_max(event_type, (ts, event_id)) AS status, max((ts, event_id)).event_id AS last_event FROM (SELECT user_id, event_type, {'ts': ts, 'event_id': event_id} AS k, ts, event_id FROM events) GROUP BY user_id".replace("arg_max(event_type, (ts, event_id))", "arg_max(event_type, k)").replace("max((ts, event_id)).event_id", "max(k).event_id"))
def worker_last_state(spark, sf_dir):
    """Last known state of every worker, after all events."""
    return progress.drained(progress.last_state(progress.events(spark, sf_dir)), folder(spark))


@query("SELECT event_id, event_id // 50 + 1 AS batch, event_id % 3 AS worker, ceil((SELECT count(*) FROM events) / 50.0)::BIGINT AS batches FROM events")
def batch_numbers(spark, sf_dir):
    """Batches of 50 and three worker slots by place (event ids are places)."""
    ev = table(spark, sf_dir, "events").select("event_id")
    n = ev.agg(F.ceil(F.count("*") / 50).alias("batches"))
    return ev.crossJoin(F.broadcast(n)).select("event_id", (F.floor(F.col("event_id") / 50) + 1).alias("batch"), F.pmod("event_id", F.lit(3)).alias("worker"), "batches")  # one row


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= {CLOSED}")
def tumbling_windows(spark, sf_dir):
    """Extension: daily counts of closed windows, with a watermark of an hour."""
    out = progress.drained(progress.tumbling(progress.events(spark, sf_dir)), folder(spark), "append")
    return _closed(spark, sf_dir, out, F.col("start") + F.expr("INTERVAL 1 DAY"))


def _closed(spark, sf_dir, out, end):
    last = table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("last"))
    return out.crossJoin(F.broadcast(last)).where(end <= F.col("last")).drop("last")  # one row


@query(
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT * FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k) WHERE "end" <= {CLOSED}"""
)
def session_windows(spark, sf_dir):
    """Extension: closed sessions of each user, with a gap of 30 minutes."""
    out = progress.drained(progress.sessions(progress.events(spark, sf_dir)), folder(spark), "append")
    return _closed(spark, sf_dir, out, F.col("end"))
