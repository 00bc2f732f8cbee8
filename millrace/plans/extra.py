"""Look-ups, guards, names of paths, orders, statistics and injected services, each bound to the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query, registered
from ..functions import paths
from ..functions import text as tx
from ..functions import urls
from ..operators import ann, crawl, edits, fusion, html, lexical, lookup, services, vector
from ..sources.shared import folder, kept
from ..sources.tables import asked, pairs, table, topics
from ..streaming import progress
from . import sql as S
from .base import CASES, QA, _cases
from .search import LIST, NORMALIZED, cascade_v1, cascade_v2, _docs, _semantic, _top
from .web import AUTH, H1, KIND_SQL, LINKS, BARE, _links, _pages

NORMQ = S.norm("question")


# look-ups and guards ---------------------------------------------------------------------------------


@query(QA + "SELECT upper(topic) AS name, min(topic_index) AS topic_index, min(topic_index) FILTER (topic = upper(topic)) AS exact_index FROM qa GROUP BY ALL")
def topic_by_name(spark, sf_dir):
    """The first topic of a name in any case, and of exactly that name."""
    qa = pairs(spark, sf_dir).select("topic_index", "topic").distinct()
    return lookup.by_name(qa.select(F.upper("topic").alias("name")).distinct(), qa, "topic", "topic_index")


@query(f"WITH {H1}\nSELECT page_id, count(*) FILTER (length(trim(heading)) > 3) AS headings, count(*) FILTER (length(trim(heading)) > 2) AS elements FROM h GROUP BY page_id")
def heading_lengths(spark, sf_dir):
    """Headings that are long enough for a node (over 3 characters) and for an element (over 2)."""
    own = html.elements(_pages(spark, sf_dir)).where("element_type = 'heading'")
    long = lambda n: F.count_if(F.length(F.trim("text")) > n)
    return own.groupBy("page_id").agg(long(3).alias("headings"), long(2).alias("elements"))


CONTENT = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'No content extracted' WHEN doc_id % 13 = 0 THEN '' ELSE text END"


@query(f"SELECT CASE WHEN coalesce({CONTENT}, '') IN ('', 'No content extracted', 'AI extraction failed', 'API key not available') THEN 'skipped' ELSE 'pending' END AS status, count(*) AS n FROM documents GROUP BY 1")
def content_guard(spark, sf_dir):
    """Contents that say nothing are skipped."""
    made = F.expr(CONTENT)
    return table(spark, sf_dir, "documents").groupBy(paths.content_status(made).alias("status")).agg(F.count("*").alias("n"))


@query(QA + "SELECT target, count(*) AS n FROM qa, (SELECT unnest(['all', 'TOPIC 1', 'topic 12', 'none']) AS target) WHERE lower(target) = 'all' OR contains(lower(topic), lower(target)) GROUP BY target")
def target_topics(spark, sf_dir):
    """Pairs of the topics that a target names."""
    qa = pairs(spark, sf_dir).withColumn("target", F.explode(F.array(*map(F.lit, ("all", "TOPIC 1", "topic 12", "none")))))
    return qa.where(paths.targeted(F.col("topic"), F.col("target"))).groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE 't' || turn = 't1' OR ends_with(conv_id || '/' || role, '/user') GROUP BY conv_id")
def topic_nodes(spark, sf_dir):
    """Nodes that are a topic's by title or by the end of their path."""
    own = table(spark, sf_dir, "conversations")
    hit = paths.names_node(F.concat(F.lit("t"), "turn"), F.concat_ws("/", "conv_id", "role"), F.lit("t1")) | paths.names_node(F.lit(""), F.concat_ws("/", "conv_id", "role"), F.lit("user"))
    return own.where(hit).groupBy("conv_id").agg(F.count("*").alias("n"))


@query(QA + ", t AS (SELECT topic_index, count(*) AS n FROM qa GROUP BY ALL) SELECT conv_id, count(*) AS asked, count(*) FILTER (turn < n) AS valid FROM conversations JOIN t ON conv_id = topic_index GROUP BY conv_id")
def index_bounds(spark, sf_dir):
    """Positions that were asked for (each turn's number) and those that the topic has."""
    n = pairs(spark, sf_dir).groupBy("topic_index").agg(F.count("*").alias("n"))
    own = table(spark, sf_dir, "conversations").join(n, F.col("conv_id") == F.col("topic_index"))
    ok = paths.in_bounds(F.lit(0), F.col("turn"), F.lit(1), F.col("n"))
    return own.groupBy("conv_id").agg(F.count("*").alias("asked"), F.count_if(ok).alias("valid"))


CASES2 = "c AS (SELECT idx AS case_id, CASE idx % 3 WHEN 0 THEN question WHEN 1 THEN question || ' !' ELSE 'unknown ' || question END AS original FROM qa)"


@query(S.with_qa(CASES2, f"e AS (SELECT question, max(idx) AS idx FROM qa GROUP BY question), n AS (SELECT {NORMQ} AS q, max(idx) AS idx FROM qa GROUP BY 1)") + f"\nSELECT case_id, coalesce(e.idx, n.idx) AS idx FROM c LEFT JOIN e ON e.question = c.original LEFT JOIN n ON n.q = {S.norm('c.original')} WHERE coalesce(e.idx, n.idx) IS NOT NULL")
def case_index(spark, sf_dir):
    """Evaluation cases and their pair: by the exact question, else by the normalised one; the last wins, and cases without one go."""
    qa = pairs(spark, sf_dir)
    cases = qa.select(F.col("idx").alias("case_id"), F.expr("CASE idx % 3 WHEN 0 THEN question WHEN 1 THEN question || ' !' ELSE 'unknown ' || question END").alias("original"))
    return lookup.cases(cases, qa)


@query(QA + "SELECT q.idx, x.answer AS expected FROM qa q JOIN (SELECT lower(question) AS k, arg_max(answer, idx) AS answer FROM qa GROUP BY 1) x ON lower(q.question) = x.k")
def expected_answers(spark, sf_dir):
    """The answer that an original question expects (the last of equal ones); questions without one go."""
    qa = pairs(spark, sf_dir)
    known = lookup.last_of(qa.select(F.lower("question").alias("key"), "answer", "idx"), "key", "answer", "idx")
    return qa.select("idx", F.lower("question").alias("key")).join(known, "key").select("idx", F.col("answer").alias("expected"))


@query(S.with_qa(S.bm25()) + f", best AS ({S.ranked('bm25', 3)}), t AS (SELECT query_id, rank, question FROM best JOIN qa USING (idx))\nSELECT query_id, rank, min(idx) AS idx FROM t JOIN qa USING (question) GROUP BY query_id, rank")
def candidate_index(spark, sf_dir):
    """The first pair whose question equals a candidate's text."""
    qa = pairs(spark, sf_dir)
    best = _top(lexical.bm25(asked(spark, sf_dir), qa.select("idx", F.concat_ws(" ", "question", "answer").alias("text"))), 3)
    texts = best.join(qa.select("idx", "question"), "idx").select("query_id", "rank", F.col("question").alias("key"))
    return texts.join(lookup.first_of(qa.select(F.col("question").alias("key"), "idx"), "key", "idx"), "key").select("query_id", "rank", "idx")


@query(QA + "SELECT topic_index, count(*) AS n, count(*) BETWEEN 2 AND 12 AS valid FROM qa GROUP BY topic_index")
def generated_sizes(spark, sf_dir):
    """Whether each topic's list of pairs has a valid size (2 to 12)."""
    own = topics(pairs(spark, sf_dir))
    return own.select("topic_index", F.size("qa_pairs").cast("long").alias("n"), paths.valid_size(F.col("qa_pairs")).alias("valid"))


# statistics and orders -------------------------------------------------------------------------------


@query("SELECT event_type AS status, count(*) AS items, CAST(sum(coalesce(qa_count, 0)) AS BIGINT) AS qa_count, count(*) FILTER (event_type = 'error') AS failed FROM (SELECT event_type, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS qa_count FROM events) GROUP BY event_type")
def status_counts(spark, sf_dir):
    """Items by status with their pairs, and those that failed."""
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.expr("CASE WHEN event_id % 5 > 0 THEN event_id % 5 END").alias("qa_count"))
    return own.groupBy("status").agg(F.count("*").alias("items"), F.sum(F.coalesce("qa_count", F.lit(0))).alias("qa_count"), F.count_if(F.col("status") == "error").alias("failed"))


@query(QA + "SELECT count(DISTINCT topic) AS buckets, count(*) AS questions, round(count(*) / count(DISTINCT topic), 4) AS per_bucket FROM qa")
def bucket_stats(spark, sf_dir):
    """Distinct buckets and the mean number of questions in one."""
    qa = pairs(spark, sf_dir)
    n = F.count_distinct("topic")
    return qa.agg(n.alias("buckets"), F.count("*").alias("questions"), F.round(F.try_divide(F.count("*"), n), 4).alias("per_bucket"))


@query("SELECT lang, source, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY ALL")
def first_seen_groups(spark, sf_dir):
    """Groups with the place where each was seen first, which is their order."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


@query(f"WITH {LINKS}\nSELECT page_id, lower(text) AS heading, arg_max(href, pos) AS content, md5(string_agg(href, ' ' ORDER BY pos)) AS links FROM l GROUP BY ALL")
def heading_relations(spark, sf_dir):
    """What stands under equal headings of a page: the last content, and all links in order (as a digest)."""
    own = _links(spark, sf_dir).select("page_id", F.lower("text").alias("heading"), F.col("href").alias("content"), F.col("href").alias("link"), "pos")
    out = crawl.relations(own, ["page_id"])
    return out.select("page_id", "heading", "content", F.md5(F.array_join("links", " ")).alias("links"))


@query(f"WITH {LINKS}, r AS (SELECT DISTINCT page_id, href, text, (text <> upper(text))::INT AS kind, length(href) - length(replace(href, '/', '')) AS depth FROM l)\nSELECT page_id, href, text, row_number() OVER (PARTITION BY page_id ORDER BY kind, depth, href, text) AS place FROM r")
def children_order(spark, sf_dir):
    """Order of a node's children: headings first (here, texts in capitals), then by depth, then by path."""
    own = _links(spark, sf_dir).select("page_id", "href", "text").distinct()
    order = Window.partitionBy("page_id").orderBy(F.col("text") != F.upper("text"), paths.slashes(F.col("href")), "href", "text")
    return own.withColumn("place", F.row_number().over(order))


@query(f"SELECT page_id, {AUTH} AS host, row_number() OVER (PARTITION BY {AUTH} ORDER BY length(url) - length(replace(url, '/', '')), page_id) AS place FROM pages")
def paths_by_depth(spark, sf_dir):
    """Order of a site's paths: by depth, then as they came."""
    host = urls.authority(F.col("url"))
    order = Window.partitionBy("host").orderBy(paths.slashes(F.col("url")), "page_id")
    return _pages(spark, sf_dir).select("page_id", host.alias("host"), "url").withColumn("place", F.row_number().over(order)).drop("url")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def seeded_sample(spark, sf_dir):
    """A sample of five documents a language that a seed makes repeatable."""
    return lookup.sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), 5, "doc_id", 7, "lang")


@query(QA + f"SELECT idx, len({S.lemmas('question')}) AS lemmas, list_has_any({S.lemmas('question')}, {S.lemmas('answer')}) AS alike FROM qa")
def lemma_overlap(spark, sf_dir):
    """Lemmas of a question, and whether its answer has one of them (the lemma function is injected; here it drops endings)."""
    q, a = (paths.lemmas(F.col(c), tx.bare_word) for c in ("question", "answer"))
    return pairs(spark, sf_dir).select("idx", F.size(q).cast("long").alias("lemmas"), F.arrays_overlap(q, a).alias("alike"))


@query(S.with_qa() + f", w AS (SELECT DISTINCT unnest({S.words('query')}) AS word FROM ask)\nSELECT word, CASE WHEN starts_with(word, 'co') AND length(word) > 4 THEN 'co' || {S.STEM.format(w='substr(word, 3)')} END AS related, contains('the condition of a community', {S.STEM.format(w='word')}) AS in_text FROM w")
def related_stems(spark, sf_dir):
    """Further stems of a word, and whether its stem occurs in a text."""
    own = asked(spark, sf_dir).select(F.explode(tx.words(F.col("query"))).alias("word")).distinct()
    w = F.col("word")
    return own.select("word", F.get(paths.related_stems(w, tx.bare_word), F.lit(0)).alias("related"), paths.stem_match(tx.bare_word(w), F.lit("the condition of a community")).alias("in_text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(left(text, 300), '[^\p{L}\p{N}_\s\-.,()]', '', 'g'), '\s+', ' ', 'g')) AS label FROM documents")
def path_texts(spark, sf_dir):
    """Texts as they stand in a path."""
    return table(spark, sf_dir, "documents").select("doc_id", paths.path_text(F.left("text", F.lit(300))).alias("label"))


URL_PATH = "regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://[^/]*/(.*)$', 1)"


@query(f"WITH p AS (SELECT page_id, url, {URL_PATH} AS path FROM pages), b AS (SELECT *, regexp_replace(translate(path, '-_/', '   '), '\\.(html|php|jsp|asp)$', '') AS bare FROM p)\nSELECT page_id, CASE WHEN path = '' THEN 'Home' ELSE left(trim(array_to_string(list_transform(regexp_extract_all(bare, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')), 50) END AS natural, split_part(split_part(url, '//', 2), '/', 1) AS title FROM b")
def natural_urls(spark, sf_dir):
    """A URL's path as words, and the title of its semantic path."""
    path = F.regexp_extract(F.element_at(F.split("url", r"[?#]", 2), 1), "^[a-z]+://[^/]*/(.*)$", 1)
    return _pages(spark, sf_dir).select("page_id", paths.natural_url(path).alias("natural"), paths.title_of_path(F.element_at(F.split("url", r"[?#]", 2), 1)).alias("title"))


@query(QA + "SELECT idx, topic_index % 2 = 0 AS changed, CASE WHEN topic_index % 2 = 0 THEN 'other' ELSE topic END AS topic, CASE WHEN topic_index % 2 = 0 THEN NULL ELSE '/' || topic END AS path FROM qa")
def pair_dicts(spark, sf_dir):
    """Pairs as maps, into which further fields are merged and win."""
    base = F.create_map(F.lit("topic"), F.col("topic"), F.lit("path"), F.concat(F.lit("/"), "topic"))
    more = F.when(F.col("topic_index") % 2 == 0, F.create_map(F.lit("topic"), F.lit("other"), F.lit("path"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    m = paths.right_wins(base, more)
    return pairs(spark, sf_dir).select("idx", (F.col("topic_index") % 2 == 0).alias("changed"), F.element_at(m, "topic").alias("topic"), F.element_at(m, "path").alias("path"))


@query(QA + ", t AS (SELECT topic_index, CASE WHEN topic_index % 3 > 0 THEN '/' || topic END AS semantic_path, qa_index, question FROM qa)\nSELECT topic_index, qa_index, coalesce(semantic_path, 'N/A') AS semantic_path, question FROM t")
def dedup_input(spark, sf_dir):
    """Pairs with their topic's path, as duplicates are looked for; 'N/A' without one."""
    own = topics(pairs(spark, sf_dir)).withColumn("semantic_path", F.when(F.col("topic_index") % 3 > 0, F.concat(F.lit("/"), "topic")))
    return own.select("topic_index", "semantic_path", F.explode("qa_pairs").alias("p")).select("topic_index", "p.qa_index", F.coalesce("semantic_path", F.lit("N/A")).alias("semantic_path"), "p.question")


@query("SELECT user_id, strftime(min(ts), '%Y%m%d_%H%M%S') AS stamp, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS iso, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2) AS seconds FROM events GROUP BY user_id")
def time_stamps(spark, sf_dir):
    """A job's start as part of a file's name, its end, and the seconds between."""
    start, end = F.min("ts"), F.max("ts")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(paths.stamp(start).alias("stamp"), paths.iso(end).alias("iso"), paths.elapsed(start, end).alias("seconds"))


@query("SELECT conv_id, coalesce(max(text) FILTER (turn = 3), max(text) FILTER (turn = 1), arg_max(text, turn)) AS tree FROM conversations GROUP BY conv_id")
def tree_source(spark, sf_dir):
    """Of a tree's sources the first there is: embedded, beside the file, the most recent."""
    own = table(spark, sf_dir, "conversations")
    at = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    return own.groupBy("conv_id").agg(lookup.first_there(at(3), at(1), F.max_by("text", "turn")).alias("tree"))


@query(QA + f", n AS (SELECT idx, topic_index, row_number() OVER (PARTITION BY {NORMQ} ORDER BY idx) AS r FROM qa)\nSELECT topic_index, count(*) AS raw, count(*) FILTER (r = 1) AS qa_count, CASE WHEN count(*) FILTER (r = 1) > 0 THEN 'completed' ELSE 'completed_deduplicated_all' END AS status FROM n GROUP BY topic_index")
def clean_stats(spark, sf_dir):
    """Topics after duplicates (equal normalised questions) are gone."""
    own = pairs(spark, sf_dir).withColumn("key", tx.normalize(F.col("question")))
    first = own.groupBy("key").agg(F.min("idx").alias("first"))
    marked = own.join(first, "key").groupBy("topic_index").agg(F.count("*").alias("raw"), F.count_if(F.col("idx") == F.col("first")).alias("qa_count"))
    return marked.withColumn("status", F.when(F.col("qa_count") > 0, "completed").otherwise("completed_deduplicated_all"))


# pages ------------------------------------------------------------------------------------------------


@query()
def discovered_headings(spark, sf_dir):
    """Headings with a paragraph among their next five siblings."""
    return html.siblings(_pages(spark, sf_dir)).where("kind = 'heading' and paragraph_follows").select("page_id", "pos", "text")


@query()
def link_contexts(spark, sf_dir):
    """Links with the beginning of their parent element's HTML, 500 characters at most."""
    own = html.siblings(_pages(spark, sf_dir)).where("kind = 'link'")
    return own.where(~F.coalesce(F.startswith("href", F.lit("#")) | F.startswith("href", F.lit("javascript:")) | (F.col("href") == ""), F.lit(True))).select("page_id", "pos", "text", F.md5("context").alias("context"), F.length("context").alias("chars"))


@query(rf"""WITH {H1}, {BARE}, t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM bare), n AS (SELECT page_id, count(*) AS n FROM t WHERE {KIND_SQL} IS NOT NULL GROUP BY page_id)
SELECT page_id, url AS original_url, 'https://' || {AUTH} || '/' || left(heading, 50) AS semantic_path, left(heading, 50) AS primary_heading, length(url) - length(replace(url, '/', '')) - 2 AS depth, n AS element_count FROM h JOIN n USING (page_id)""")
def enhanced_map(spark, sf_dir):
    """Pages with their semantic path, heading, depth and number of elements."""
    found = html.elements(_pages(spark, sf_dir))
    n = found.groupBy("page_id", "url").agg(F.count("*").alias("element_count"))
    own = n.join(html.primary_heading(found), "page_id")
    path = F.concat(F.lit("https://"), urls.authority(F.col("url")), F.lit("/"), "heading")
    return own.select("page_id", F.col("url").alias("original_url"), path.alias("semantic_path"), F.col("heading").alias("primary_heading"), (paths.slashes(F.col("url")) - 2).alias("depth"), "element_count")


# vectors and services ----------------------------------------------------------------------------------


def _both(spark, sf_dir, text):
    q = asked(spark, sf_dir).select("query_id", vector.encode(F.col("query")).alias("vec"))
    return vector.search(q, pairs(spark, sf_dir).select("idx", vector.encode(text).alias("vec")), 10)


@query(S.with_qa(S.semantic("b", "question || ' ' || answer")) + f"\n{LIST} FROM ({S.ranked('b', 10)})")
def combined_vectors(spark, sf_dir):
    """Nearest pairs by one vector of question and answer."""
    return _both(spark, sf_dir, F.concat_ws(" ", "question", "answer"))


@query(S.with_qa(S.semantic("b", "question || ' ' || left(answer, 500)")) + f"\n{LIST} FROM ({S.ranked('b', 10)})")
def hosted_vectors(spark, sf_dir):
    """The same over the first 500 characters of the answer, as a hosted encoder takes them."""
    return _both(spark, sf_dir, F.concat_ws(" ", "question", F.left("answer", F.lit(500))))


@query(f"SELECT item_id, CASE WHEN contains(text, '!') THEN 0.0 ELSE CAST(len({S.tokens('text')}) AS DOUBLE) END AS total FROM benchmark")
def service_vectors(spark, sf_dir):
    """Vectors of an injected service, called a text at a time here: a call that fails (for texts with '!') gives zeros."""

    def embed(texts: list[str]) -> list[list[float]]:
        if any("!" in t for t in texts):
            raise OSError("the service is down")
        return [vector.encode_text(t) for t in texts]

    made = services.batched(embed, vector.DIM, 1)(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.aggregate(made, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query()
def ann_search(spark, sf_dir):
    """Nearest of all vectors by an index that took them in two batches, for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    index = ann.Index(spark, folder(spark), len(rows.first()["vec"]))
    index.rebuild(rows.where("idx % 2 = 0"))
    index.add(rows.where("idx % 2 = 1"))
    return index.search(rows.where("idx % 50 = 0").select(F.col("idx").alias("query_id"), "vec"), 1)


@query(QA + f", n AS (SELECT idx, question, row_number() OVER (PARTITION BY {NORMQ} ORDER BY idx) - 1 AS r FROM qa)\nSELECT idx AS id, least(r, 3) AS refinements, question || CASE WHEN r = 0 THEN '' WHEN r = 1 THEN ' (1)' WHEN r = 2 THEN ' (1) (2)' ELSE ' (1) (2) (3)' END AS question FROM n")
def refined_pairs(spark, sf_dir):
    """Pairs whose question repeats an earlier one are refined up to three times, then accepted as they are."""

    def near(rows, every):
        first = every.groupBy(tx.normalize(F.col("question")).alias("key")).agg(F.min("id").alias("first"))
        return rows.withColumn("key", tx.normalize(F.col("question"))).join(first, "key").where("id > first").select("id")

    own = pairs(spark, sf_dir).select(F.col("idx").alias("id"), "question", "answer")
    return services.refined(own, near, services.Services()).select("id", F.col("refinements").cast("long").alias("refinements"), "question")


@query("SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN length(text) END AS chars, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: no content' END AS error FROM documents")
def guarded_items(spark, sf_dir):
    """Items one at a time: one that fails carries its error, and the others go on."""

    def work(row: dict) -> dict:
        if row["doc_id"] % 10 == 0:
            raise ValueError("no content")
        return {"chars": len(row["text"])}

    return services.guarded(table(spark, sf_dir, "documents").select("doc_id", "text"), work, "chars long").drop("text")


V2_SQL = registered("cascade_v2")
ROUTES = {"v1": cascade_v1, "v2": cascade_v2}


@query(V2_SQL)
def routed_answers(spark, sf_dir):
    """The newest version of the cascade that is switched on answers."""
    return services.Router(ROUTES, ("v1", "v2")).answer(spark, sf_dir)


# positions and streams ----------------------------------------------------------------------------------


@query(QA + "SELECT topic_index, max(question) FILTER (qa_index = 0) AS first, count(*) AS n, count(*) - 1 AS n_less FROM qa GROUP BY topic_index")
def pair_positions(spark, sf_dir):
    """The pair at a position, and the topic without it."""
    own = topics(pairs(spark, sf_dir))
    less = edits.remove_at(own, 0)
    got = own.select("topic_index", edits.pair_at(0)["question"].alias("first"), F.size("qa_pairs").cast("long").alias("n"))
    return got.join(less.select("topic_index", F.size("qa_pairs").cast("long").alias("n_less")), "topic_index")


@query("SELECT CASE event_type WHEN 'view' THEN 'worker_update' WHEN 'click' THEN 'item_completed' WHEN 'signup' THEN 'phase_start' WHEN 'purchase' THEN 'batch_completed' ELSE 'error' END AS type, count(*) AS n FROM events GROUP BY 1")
def stream_types(spark, sf_dir):
    """Events under the names that a progress stream gives them."""
    out = progress.typed(progress.events(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))
    return progress.drained(out, folder(spark))


@query("SELECT user_id AS job, max(event_id) AS current, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS topics_completed, CAST(coalesce(sum(event_id % 5) FILTER (event_type = 'click'), 0) AS BIGINT) AS qa_generated, arg_max(event_type, {'ts': ts, 'e': event_id}) AS last FROM events GROUP BY user_id")
def progress_snapshot(spark, sf_dir):
    """Each job's figures over all of its events."""
    return progress.drained(progress.snapshot(progress.events(spark, sf_dir), F.col("event_id") % 5), folder(spark))


@query(
    """WITH b AS (SELECT event_id // 50 + 1 AS batch, count(*) AS n FROM events GROUP BY 1), t AS (SELECT max(batch) AS total FROM b)
SELECT batch, 'batch_completed' AS type, n FROM b UNION ALL SELECT batch, 'batch_transition', NULL FROM b, t WHERE batch < total UNION ALL SELECT total, 'completed', NULL FROM t"""
)
def stitched_batches(spark, sf_dir):
    """One stream over several batches: each completed, with a transition between two and one end."""
    own = table(spark, sf_dir, "events").withColumn("batch", F.floor(F.col("event_id") / 50) + 1)
    return progress.stitched(own.groupBy("batch").agg(F.count("*").alias("n")))


# cascades with services, and all methods ------------------------------------------------------------------

SERVICES = services.Services()
KW, SHARE = S.keywords("query"), "len(list_intersect({a}, {b})) / greatest(len({a}), 1)"
OVERLAP = SHARE.format(a=S.words("query"), b=S.words("question || ' ' || answer"))


@query(S.with_qa(S.bm25(), f"c AS ({S.ranked('bm25', 10)}), z AS (SELECT query_id, idx, round(1 / (1 + exp(-(8 * {OVERLAP} - 4))), 6) AS score FROM c JOIN ask USING (query_id) JOIN qa USING (idx))") + "\nSELECT query_id, idx, score, score >= 0.5 AS passed, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM z")
def service_rerank(spark, sf_dir):
    """BM25's ten best by an injected reranker (by default, the share of the query's words that a pair has)."""
    q, qa = asked(spark, sf_dir), pairs(spark, sf_dir)
    return fusion.rescored(_top(lexical.bm25(q, _docs(qa, "both")), 10), q, qa, SERVICES.rerank)


@query(S.with_qa(S.bm25(), f"c AS ({S.ranked('bm25', 1)})") + f"\nSELECT query_id, idx, score, CASE WHEN {SHARE.format(a=KW, b=S.words('answer'))} >= 0.5 THEN 'Entailment' ELSE 'Neutral' END AS verdict, {SHARE.format(a=KW, b=S.words('answer'))} >= 0.5 AS accepted FROM c JOIN ask USING (query_id) JOIN qa USING (idx)")
def verified_answers(spark, sf_dir):
    """The best pair by BM25 with an injected verifier's verdict (by default, whether the answer has half of the keywords)."""
    q, qa = asked(spark, sf_dir), pairs(spark, sf_dir)
    return fusion.verified(_top(lexical.bm25(q, _docs(qa, "both")), 1), q, qa, SERVICES.verify)


@query(S.with_qa(S.semantic("sq", "question"), f"k AS (SELECT DISTINCT query_id, idx FROM (SELECT query_id, unnest({KW}) AS word FROM ask) JOIN (SELECT idx, unnest({S.words("question || ' ' || answer")}) AS word FROM qa) USING (word)), f AS (SELECT query_id, idx, score FROM sq JOIN k USING (query_id, idx))") + f"\n{LIST} FROM ({S.ranked('f', 10)})")
def entity_semantic(spark, sf_dir):
    """Nearest pairs among those that have one of the query's entities (by default, its keywords); none without one."""
    q, qa = asked(spark, sf_dir), pairs(spark, sf_dir)
    left = fusion.filtered(q, qa, SERVICES.entities)
    vectors = left.join(q.select("query_id", vector.encode(F.col("query")).alias("a")), "query_id").join(qa.select("idx", vector.encode(F.col("question")).alias("b")), "idx")
    return _top(vectors.select("query_id", "idx", vector.cosine(F.col("a"), F.col("b")).alias("score")).where("score is not null"), 10)


def _as_cases(sql: str) -> str:
    return sql.replace("FROM ask", "FROM cases").replace("JOIN ask", "JOIN cases")


_jac = "round(inter / (nq + nd - inter), 6)"
METHODS = {
    "bm25": (_as_cases(S.bm25(docs="SELECT idx, question AS text FROM qa")), "bm25"),
    "normalized": (_as_cases(S.shared("x", S.words)) + ", " + _as_cases(NORMALIZED), "n"),
    "stemmed": (_as_cases(S.shared("st", S.stems)) + ", sr AS (SELECT query_id, idx, round(0.5 * inter / (nq + nd - inter) + 0.5 * inter / greatest(nq, 1), 6) AS score FROM st)", "sr"),
    "fuzzy": (_as_cases(S.shared("xa", S.ascii_words) + ", " + S.fuzzy("fz", "xa")), "fz"),
    "ngram": (_as_cases(S.shared("y", S.ngrams)) + f", yr AS (SELECT query_id, idx, {_jac} AS score FROM y)", "yr"),
    "question_vector": (_as_cases(S.semantic("sq", "question")), "sq"),
    "pair_vector": (_as_cases(S.semantic("sb", "question || ' ' || answer")), "sb"),
}
_hits = " UNION ALL ".join(f"SELECT '{m}' AS method, query_id, idx, rank FROM ({S.ranked(t, 5)})" for m, (_, t) in METHODS.items())
_shares = ", ".join(f"round(100.0 * count(*) FILTER (rank <= {k} AND query_id = idx) / (SELECT count(*) FROM cases), 6) AS top{k}" for k in (1, 3, 5))


@query(S.with_qa(CASES, *(p for p, _ in METHODS.values()), f"hits AS ({_hits}), m AS (SELECT method, {_shares} FROM hits GROUP BY method)") + "\nSELECT *, row_number() OVER (ORDER BY top1 DESC, method) AS place FROM m")
def all_methods(spark, sf_dir):
    """Accuracy of seven methods on rephrased questions, the best first."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cases, qa = (kept(df.repartition(parts)) for df in (_cases(spark, sf_dir), pairs(spark, sf_dir)))  # read many times
    docs = _docs(qa)
    vec = lambda t: vector.search(cases.select("query_id", vector.encode(F.col("query")).alias("vec")), kept(qa.select("idx", vector.encode(t).alias("vec"))), 5).drop("rank")
    own = {
        "bm25": lexical.bm25_nearest(cases, docs, 5), "normalized": lexical.normalized_nearest(cases, docs, 5), "stemmed": lexical.stemmed_nearest(cases, docs, tx.stem_words, 5),
        "fuzzy": lexical.fuzzy_nearest(cases, docs, 5), "ngram": lexical.jaccard_nearest(cases, docs, tx.ngrams, 5),
        "question_vector": vec(F.col("question")), "pair_vector": vec(F.concat_ws(" ", "question", "answer")),
    }
    ranked = None
    for name, df in own.items():
        part = _top(df, 5).select(F.lit(name).alias("method"), "query_id", "idx", "rank")
        ranked = part if ranked is None else ranked.unionByName(part)
    n = cases.agg(F.count("*").alias("n"))
    share = lambda k: F.round(100.0 * F.count_if((F.col("rank") <= k) & (F.col("query_id") == F.col("idx"))) / F.col("n"), 6).alias(f"top{k}")
    out = ranked.crossJoin(F.broadcast(n)).groupBy("method", "n").agg(share(1), share(3), share(5)).drop("n")  # one row
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("top1"), "method")))  # a row a method
