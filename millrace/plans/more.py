"""Labels, displays, lookups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import labels, sets
from ..functions import text as tx
from ..operators import crawl, fusion, html, lexical
from ..sources.shared import folder
from ..sources.tables import asked, pairs, table
from ..streaming import progress
from . import sql as S
from .base import QA, _closed
from .search import SEMANTIC_A, SEMANTIC_Q, _docs, _semantic, _six, _top
from .web import LINKS, _pages

GENERIC = ", ".join(f"'{g}'" for g in tx.GENERIC)


def _generic(x: str) -> str:
    return f"(length(lower(trim({x}))) <= 1 OR regexp_matches({x}, '^\\d+$') OR lower(trim({x})) IN ({GENERIC}))"


def _link_rows(spark, sf_dir):
    return html.links(html.elements(_pages(spark, sf_dir)))


@query(f"WITH {LINKS}\nSELECT page_id, count(*) FILTER ({_generic('text')}) AS generic, count(*) AS n FROM l GROUP BY page_id")
def generic_labels(spark, sf_dir):
    """Links of a page whose text says nothing."""
    return _link_rows(spark, sf_dir).groupBy("page_id").agg(F.count_if(tx.generic_label(F.col("text"))).alias("generic"), F.count("*").alias("n"))


@query(f"WITH {LINKS}\nSELECT DISTINCT page_id, text, CASE WHEN length(text) <= 50 AND NOT {_generic('text')} THEN text ELSE left(text, 50) END AS label FROM l WHERE length(text) BETWEEN 1 AND 99")
def link_labels(spark, sf_dir):
    """Final labels of links that have a text."""
    own = html.elements(_pages(spark, sf_dir)).where("element_type = 'link' and length(text) between 1 and 99")
    href = F.lit(None).cast("string")
    label = labels.final(labels.heuristic(F.col("text"), F.create_map().cast("map<string,string>"), href), F.col("text"), href)
    return own.select("page_id", "text", label.alias("label")).distinct()


def _case(name: str, forms) -> str:
    return "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in forms) + f"][length(question) % {len(forms)} + 1]"


@query(
    QA + "SELECT idx, CASE " + " ".join(f"WHEN regexp_matches(trim(question), '(?i)^{w} ') THEN {_case(w, f)} || substr(trim(question), {len(w) + 2})" for w, f in labels.REPHRASED.items())
    + f" ELSE {_case('', labels.OPENINGS)} || trim(question) END AS rephrased FROM qa"
)
def rephrased_questions(spark, sf_dir):
    """Another wording of every question (the choice follows from its length)."""
    return pairs(spark, sf_dir).select("idx", labels.rephrase(F.col("question"), F.length("question")).alias("rephrased"))


@query("""SELECT doc_id, md5(regexp_replace(text, '(?i)the', '>>>THE<<<', 'g')) AS highlighted, CASE WHEN instr(lower(text), 'the') > 0 THEN substr(text, greatest(1, instr(lower(text), 'the') - 20), instr(lower(text), 'the') + 33 - greatest(1, instr(lower(text), 'the') - 20)) END AS snippet FROM documents""")
def snippets(spark, sf_dir):
    """Highlighted texts (as digests) and what stands around the first match."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(labels.highlight(t, "the")).alias("highlighted"), labels.snippet(t, "the").alias("snippet"))


@query("SELECT role, arg_max(text, {'c': conv_id, 't': turn}) AS text, count(*) AS n FROM conversations GROUP BY role")
def last_value_lookup(spark, sf_dir):
    """Lookup of a name that occurs often: the last value wins."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.max_by("text", F.struct("conv_id", "turn")).alias("text"), F.count("*").alias("n"))


@query(S.with_qa(SEMANTIC_Q, SEMANTIC_A) + f"\nSELECT a.query_id, a.rank, a.idx AS question_idx, b.idx AS answer_idx, a.idx = b.idx AS same FROM ({S.ranked('sq', 5)}) a JOIN ({S.ranked('sa', 5)}) b ON a.query_id = b.query_id AND a.rank = b.rank")
def compare_vector_sets(spark, sf_dir):
    """The first five under two sets of vectors, side by side."""
    a = _semantic(spark, sf_dir, "question", 5).select("query_id", "rank", F.col("idx").alias("question_idx"))
    b = _semantic(spark, sf_dir, "answer", 5).select("query_id", "rank", F.col("idx").alias("answer_idx"))
    return a.join(b, ["query_id", "rank"]).withColumn("same", F.col("question_idx") == F.col("answer_idx"))


@query(S.with_qa(SEMANTIC_Q) + f"\nSELECT query_id, r.idx, topic, answer, score FROM ({S.ranked('sq', 1)}) r JOIN qa USING (idx)")
def nearest_answer(spark, sf_dir):
    """The answer and topic of the nearest pair, whatever its score."""
    best = _semantic(spark, sf_dir, "question", 1).select("query_id", "idx", "score")
    return best.join(pairs(spark, sf_dir).select("idx", "topic", "answer"), "idx").select("query_id", "idx", "topic", "answer", "score")


@query(
    S.with_qa(S.bm25(), f"c AS ({S.ranked('bm25', 10)}), o AS (SELECT query_id, c.idx, round(1 / (1 + exp(-(8 * len(list_intersect({S.words('query')}, {S.words('question')})) / greatest(len({S.words('query')}), 1) - 1))), 6) AS score FROM c JOIN qa USING (idx) JOIN ask USING (query_id))")
    + "\nSELECT query_id, idx, score, score >= 0.5 AS passed, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM o"
)
def cross_scored(spark, sf_dir):
    """BM25's first ten, reranked by a stand-in for a pair scorer (word overlap as log odds)."""
    q, qa = asked(spark, sf_dir), pairs(spark, sf_dir)
    found = _top(lexical.bm25(q, _docs(qa, "both")), 10).select("query_id", "idx").join(q, "query_id").join(qa.select("idx", "question"), "idx")
    return fusion.reranked(found, 8 * sets.overlap(tx.words(F.col("query")), tx.words(F.col("question"))) - 1)


@query(QA + ", p AS (SELECT idx, regexp_extract_all(question, '[A-Z][a-z]+ [A-Z][a-z]+') AS persons, question, answer FROM qa)\nSELECT idx, len(persons) AS n FROM p WHERE len(list_filter(persons, lambda x: contains(lower(x), 'the'))) > 0 OR (len(persons) = 0 AND contains(lower(question || ' ' || answer), 'the'))")
def entity_filter(spark, sf_dir):
    """Pairs about an entity: among the names found, or, without any, anywhere in the text."""
    own = pairs(spark, sf_dir).withColumn("persons", F.regexp_extract_all("question", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0)))
    named = F.exists("persons", lambda x: F.lower(x).contains("the"))
    plain = (F.size("persons") == 0) & F.lower(F.concat_ws(" ", "question", "answer")).contains("the")
    return own.where(named | plain).select("idx", F.size("persons").alias("n"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in ("click", "error", "purchase")) + ", count(*) AS n FROM events GROUP BY user_id")
def event_crosstab(spark, sf_dir):
    """Events of each worker by type."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "error", "purchase")), F.count("*").alias("n"))


@query(QA + "SELECT count(DISTINCT topic) AS topics, count(*) AS pairs, round(count(*) / count(DISTINCT topic), 6) AS per_topic, max(length(answer)) AS longest FROM qa")
def dashboard(spark, sf_dir):
    """Figures of the whole knowledge base."""
    n = F.countDistinct("topic")
    return pairs(spark, sf_dir).agg(n.alias("topics"), F.count("*").alias("pairs"), F.round(F.count("*") / n, 6).alias("per_topic"), F.max(F.length("answer")).alias("longest"))


@query(
    """WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS ord, CASE WHEN turn > (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id) THEN conv_id * 1000 + turn - 1 END AS parent_ord, role || turn AS label FROM conversations c),
p AS (SELECT ord, label AS path FROM n WHERE parent_ord IS NULL UNION ALL SELECT n.ord, p.path || '/' || n.label FROM p JOIN n ON n.parent_ord = p.ord) SELECT ord, path FROM p"""
)
def relabel_paths(spark, sf_dir):
    """Paths from root to leaf, from every node's own label (turns below the turns before)."""
    chat = table(spark, sf_dir, "conversations")
    first = chat.groupBy("conv_id").agg(F.min("turn").alias("least"))
    # Keys that no other conversation shares, however many turns there are; the number is made for the result only.
    own, up = F.struct("conv_id", "turn"), F.struct("conv_id", (F.col("turn") - 1).alias("turn"))
    nodes = chat.join(first, "conv_id").select(own.alias("ord"), F.when(F.col("turn") > F.col("least"), up).alias("parent_ord"), F.concat("role", "turn").alias("label"))
    return crawl.relabel(nodes).select((F.col("ord.conv_id") * 1000 + F.col("ord.turn")).alias("ord"), "path")


@query("SELECT * FROM (SELECT start, count(*) AS n FROM (SELECT unnest([CAST(date_trunc('day', ts) AS TIMESTAMP), CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY start) WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def sliding_windows(spark, sf_dir):
    """Extension: closed windows of two days, one beginning every day."""
    out = progress.drained(progress.sliding(progress.events(spark, sf_dir)), folder(spark), "append")
    return _closed(spark, sf_dir, out, F.col("start") + F.expr("INTERVAL 2 DAYS"))


@query(
    "SELECT user_id AS node, coalesce(arg_min(" + " ".join(["CASE event_type", *(f"WHEN '{k}' THEN '{v}'" for k, v in progress.STEPS.items())]) + " END, {'ts': ts, 'event_id': event_id}) FILTER (event_type IN ("
    + ", ".join(f"'{k}'" for k in progress.STEPS) + ")), 'processing') AS status, count(*) AS seen FROM events GROUP BY user_id"
)
def node_status_fold(spark, sf_dir):
    """Status of every node over its events, with state of our own."""
    return progress.drained(progress.fold(progress.events(spark, sf_dir)), folder(spark), "update", ("node",))


@query(
    "WITH w AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 7 % 1000003 END AS ord FROM documents)\nSELECT doc_id, coalesce(ord, 999999) AS place FROM w"
)
def original_order(spark, sf_dir):
    """Results put back in the order of their items; unknown ones last."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    known = docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("doc_id") * 7 % 1000003).alias("ord"))
    return docs.join(known, "doc_id", "left").select("doc_id", F.coalesce("ord", F.lit(999999)).alias("place"))
