"""Contents of pages, labels of paths, and searches by spelling and by stem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import labels, stems
from ..functions import text as tx
from ..operators import fusion, html, lexical
from ..sources.tables import asked, pairs, table
from . import sql as S
from .base import QA
from .more import _generic
from .search import LIST, _docs, _top
from .web import H1, LINKS, _pages, plain


#: Paragraphs within a page's article, in order.
PARAGRAPHS = f"""{H1}, a AS (SELECT page_id, regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
c AS (SELECT page_id, list_transform(string_split(body, '<p>')[2:], lambda p: {plain("split_part(p, '</p>', 1)")}) AS ps FROM a)"""


def _found(spark, sf_dir):
    return html.elements(_pages(spark, sf_dir))


@query(f"WITH {PARAGRAPHS}\nSELECT c.page_id, heading, list_filter(ps, lambda p: length(p) > 20)[1] AS excerpt FROM c LEFT JOIN h USING (page_id)")
def article_cards(spark, sf_dir):
    """Heading and excerpt of every article."""
    return html.cards(_found(spark, sf_dir)).select("page_id", "heading", "excerpt")


@query(
    rf"""WITH {PARAGRAPHS}, t AS (SELECT page_id, array_to_string(list_filter(ps, lambda p: length(p) > 100), chr(10) || chr(10)) AS core, array_to_string(list_filter(ps, lambda p: p <> ''), chr(10) || chr(10)) AS body FROM c)
SELECT page_id, md5(CASE WHEN length(core) < 200 THEN body ELSE core END) AS content FROM t WHERE body <> ''"""
)
def main_content(spark, sf_dir):
    """Digest of each page's main content."""
    return html.main_content(_found(spark, sf_dir)).select("page_id", F.md5("text").alias("content"))


@query(f"WITH {PARAGRAPHS}\nSELECT c.page_id, heading, left(array_to_string(list_filter(ps, lambda p: length(p) > 10)[1:5], ' '), 500) AS content FROM c JOIN h USING (page_id)")
def heading_content(spark, sf_dir):
    """What stands below each heading."""
    return html.following(_found(spark, sf_dir)).select("page_id", "heading", "content")


@query(f"WITH {H1}\nSELECT page_id, left(heading, 50) AS heading FROM h WHERE heading <> ''")
def primary_headings(spark, sf_dir):
    """The heading that stands for each page."""
    return html.primary_heading(_found(spark, sf_dir))


MAIN = "|".join(labels.LEADING)


@query(
    f"""WITH {LINKS}, g AS (SELECT page_id, pos, trim(text) AS t, regexp_matches(lower(text), '{MAIN}') AS main FROM l WHERE NOT {_generic('text')} AND length(trim(text)) > 3)
SELECT page_id, left(coalesce(arg_min(t, pos) FILTER (main), arg_min(t, pos)), 50) AS text FROM g GROUP BY page_id"""
)
def meaningful_links(spark, sf_dir):
    """The link text that says the most about each page."""
    own = html.links(_found(spark, sf_dir)).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))
    return own.select("page_id", labels.meaningful(F.col("texts")).alias("text")).where("text is not null")


@query("""WITH r AS (SELECT conv_id, turn, role, lower(role) IS DISTINCT FROM lower(lag(role) OVER (PARTITION BY conv_id ORDER BY turn)) AS fresh FROM conversations)
SELECT conv_id, string_agg(role, '/' ORDER BY turn) FILTER (fresh) AS path FROM r GROUP BY conv_id""")
def role_paths(spark, sf_dir):
    """Roles of a conversation in order, repeats in a row once."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return own.select("conv_id", F.array_join(labels.without_repeats(F.col("roles")), "/").alias("path"))


@query(QA + "SELECT topic_index, md5(string_agg(chr(10) || (qa_index + 1) || '. Q: ' || question || chr(10) || '   A: ' || answer || chr(10), '' ORDER BY qa_index)) AS listed FROM qa GROUP BY topic_index")
def listed_topics(spark, sf_dir):
    """Digest of each topic's numbered questions and answers."""
    own = pairs(spark, sf_dir).groupBy("topic_index").agg(F.sort_array(F.collect_list(F.struct("qa_index", "question", "answer"))).alias("ps"))
    return own.select("topic_index", F.md5(labels.listed_pairs(F.col("ps"))).alias("listed"))


@query(S.with_qa(S.shared("x", S.words), "r AS (SELECT query_id, idx, round(0.5 * inter / (nq + nd - inter) + 0.5 * inter / greatest(nq, 1), 6) AS score FROM x)") + f"\n{LIST} FROM ({S.ranked('r', 10)})")
def stemmed_search(spark, sf_dir):
    """Stems of query and question, a word being its own stem."""
    return _top(lexical.stemmed(asked(spark, sf_dir), _docs(pairs(spark, sf_dir)), tx.words), 10)


@query()
def porter_search(spark, sf_dir):
    """The same with Porter's stems."""
    return _top(lexical.stemmed(asked(spark, sf_dir), _docs(pairs(spark, sf_dir)), lambda t: stems.stems(tx.words(t))), 10)


@query(S.with_qa(S.shared("x", S.ascii_words), S.fuzzy("r", "x")) + f"\n{LIST} FROM ({S.ranked('r', 10)})")
def fuzzy_search(spark, sf_dir):
    """Likeness of spelling of query and question, over ASCII letters and digits."""
    return _top(lexical.fuzzy_nearest(asked(spark, sf_dir), _docs(pairs(spark, sf_dir)), 10), 10)


@query(
    S.with_qa(S.bm25(), S.shared("x", S.words), f"j AS (SELECT query_id, idx, round(inter / (nq + nd - inter), 6) AS score FROM x), v AS (SELECT query_id, idx FROM ({S.ranked('bm25', 20)}) UNION ALL SELECT query_id, idx FROM ({S.ranked('j', 20)}))")
    + "\nSELECT query_id, idx, CASE count(*) WHEN 2 THEN '✓✓ Moderate Agreement' ELSE '✓ Weak Agreement' END AS consensus FROM v GROUP BY ALL"
)
def vote_consensus(spark, sf_dir):
    """How many of two retrievers list a pair, by name."""
    q, qa = asked(spark, sf_dir), pairs(spark, sf_dir)
    both = fusion.lists(bm25=_top(lexical.bm25(q, _docs(qa, "both")), 20), jaccard=_top(lexical.jaccard(q, _docs(qa), tx.words), 20))
    return fusion.rrf(both).select("query_id", "idx", labels.consensus(F.col("votes")).alias("consensus"))
