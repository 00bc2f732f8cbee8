"""Pages: elements, links, paths and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as tx
from ..functions import urls
from ..operators import crawl, html
from ..sources.tables import table

AUTH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
NORM = r"""CASE WHEN contains(w, '?') THEN b || substr(w, instr(w, '?')) ELSE b END"""
NORM_CTE = r"""n0 AS (SELECT page_id, url, split_part(url, '#', 1) AS w FROM pages), n1 AS (SELECT page_id, url, w, split_part(w, '?', 1) AS p FROM n0),
n2 AS (SELECT page_id, url, w, CASE WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/$') OR p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END AS b FROM n1),
n AS (SELECT page_id, url, """ + NORM + """ AS norm FROM n2)"""
LINKS = r"""l0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) AS pos FROM pages),
l AS (SELECT page_id, url, pos, replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href, trim(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS text FROM l0)"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _links(spark, sf_dir):
    return html.links(html.elements(_pages(spark, sf_dir)))


@query(f"WITH {NORM_CTE}\nSELECT page_id, norm, {AUTH} AS host FROM n")
def url_normalize(spark, sf_dir):
    """Normalised URL and host of each page."""
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", urls.normalize(u).alias("norm"), urls.authority(u).alias("host"))


@query(f"WITH {NORM_CTE}\nSELECT norm, min(page_id) AS page_id FROM n GROUP BY norm")
def exact_dup_urls(spark, sf_dir):
    """The first page of each normalised URL."""
    own = _pages(spark, sf_dir).select("page_id", urls.normalize(F.col("url")).alias("norm"))
    return crawl.first_wins(own, ["norm"], ["page_id"]).select("norm", "page_id")


def plain(x: str) -> str:
    """SQL for the text of a piece of HTML; entities may have lost their semicolon."""
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for mark, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{mark};?', '{char}', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


H1 = f"""h AS (SELECT page_id, url, {plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading FROM pages WHERE contains(html, '<h1>'))"""


@query(f"WITH {H1}\nSELECT page_id, heading AS text, 'h1' AS tag FROM h")
def page_headings(spark, sf_dir):
    """Headings of every page."""
    found = html.elements(_pages(spark, sf_dir)).where("element_type = 'heading'")
    return found.select("page_id", "text", "tag")


@query(f"WITH {H1}, k AS (SELECT lower(trim(left(heading, 100))) AS key, page_id, heading FROM h)\nSELECT key, min(page_id) AS page_id FROM k GROUP BY key")
def heading_first_wins(spark, sf_dir):
    """The first page of each heading text."""
    found = html.elements(_pages(spark, sf_dir)).where("element_type = 'heading'").select("page_id", "pos", F.lower(F.trim(F.left("text", F.lit(100)))).alias("key"))
    return crawl.first_wins(found, ["key"], ["page_id", "pos"]).select("key", "page_id")


@query(f"WITH {LINKS}\nSELECT page_id, href, text, count(*) AS n FROM l GROUP BY ALL")
def page_links(spark, sf_dir):
    """Links of every page."""
    return _links(spark, sf_dir).groupBy("page_id", "href", "text").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS}\nSELECT page_id, CASE WHEN regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) IN ('', {AUTH}) THEN 'internal' ELSE 'external' END AS kind, count(*) AS n, count(*) FILTER (length(text) <= 2 OR starts_with(href, '#') OR href = '') AS skipped FROM l GROUP BY ALL")
def link_class(spark, sf_dir):
    """Internal and external links of a page, and those that are skipped."""
    own = _links(spark, sf_dir)
    kind = urls.link_kind(F.col("href"), urls.authority(F.col("url")))
    skip = (F.length("text") <= 2) | F.startswith("href", F.lit("#")) | (F.col("href") == "")
    return own.groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(skip).alias("skipped"))


@query(f"WITH {LINKS}, t AS (SELECT DISTINCT page_id, href, lower(text) AS text FROM l)\nSELECT page_id, text, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1")
def link_collisions(spark, sf_dir):
    """Link texts that lead to several targets on one page."""
    own = _links(spark, sf_dir).select("page_id", "href", F.lower("text").alias("text")).distinct()
    return own.groupBy("page_id", "text").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {H1}, {LINKS.replace('l0', 'k0').replace('l AS', 'k AS')}\nSELECT page_id, 'https://' || {AUTH} || '/Home/' || heading AS path, 'heading' AS source_type FROM h UNION ALL SELECT DISTINCT page_id, 'https://' || {AUTH} || '/Home//' || text, 'link' FROM k")
def semantic_paths(spark, sf_dir):
    """Paths of headings (/) and links (//) below their site's home."""
    found = html.elements(_pages(spark, sf_dir)).where("element_type in ('heading', 'link')")
    home = F.concat(F.lit("https://"), urls.authority(F.col("url")), F.lit("/Home"))
    link = F.col("element_type") == "link"
    path = F.concat(home, F.when(link, "//").otherwise("/"), F.col("text"))
    return found.select("page_id", path.alias("path"), F.col("element_type").alias("source_type"), "pos").groupBy("page_id", "path", "source_type").agg(F.count("*").alias("n")).drop("n")


BARE = r"""bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<template[^>]*>.*?</template>', '', 'g') AS html FROM pages)"""
VISIBLE = BARE + f", seen AS (SELECT page_id, {plain('html')} AS text FROM bare)"


@query(f"WITH {VISIBLE}\nSELECT page_id, md5(text) AS digest, length(text) AS chars FROM seen")
def page_text(spark, sf_dir):
    """Digest and length of each page's visible text."""
    return html.page_text(_pages(spark, sf_dir)).select("page_id", F.md5("text").alias("digest"), F.length("text").alias("chars"))


@query()
def page_containers(spark, sf_dir):
    """Headings with the paragraphs that follow."""
    out = html.containers(html.elements(_pages(spark, sf_dir)))
    return out.select("page_id", "part", "heading", "tag", F.size("paragraphs").alias("paragraphs"), "main_link")


KIND_SQL = "CASE " + " ".join(f"WHEN tag = '{t}' THEN '{k}'" for t, k in html.KINDS.items()) + " END"


@query(rf"""WITH {BARE}, t AS (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM bare), k AS (SELECT {KIND_SQL} AS element_type FROM t)
SELECT element_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM pages), 6) AS per_page FROM k WHERE element_type IS NOT NULL GROUP BY element_type""")
def crawl_stats(spark, sf_dir):
    """Elements of all pages by kind, with the mean per page."""
    pages = _pages(spark, sf_dir)
    n = pages.agg(F.count("*").alias("pages"))
    return html.elements(pages).groupBy("element_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("element_type", "n", F.round(F.col("n") / F.col("pages"), 6).alias("per_page"))  # one row


PATHS = r"""p0 AS (SELECT page_id, rtrim(split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '#', 1), '?', 1), '/') AS path FROM pages)"""


@query(
    f"""WITH {PATHS}, p AS (SELECT DISTINCT path FROM p0), c AS (SELECT path, array_to_string(string_split(path, '/')[1:unnest(range(1, len(string_split(path, '/'))))], '/') AS prefix FROM p)
SELECT path, max_by(prefix, length(prefix)) AS parent FROM p LEFT JOIN (SELECT c.path, prefix FROM c JOIN p q ON q.path = c.prefix) USING (path) GROUP BY path"""
)
def tree_by_prefix(spark, sf_dir):
    """Each URL path and the longest other one that begins it."""
    bare = F.regexp_replace(F.element_at(F.split("url", r"[?#]", 2), 1), "^[a-z]+://", "")
    return crawl.parents_by_prefix(_pages(spark, sf_dir).select(F.regexp_replace(bare, "/+$", "").alias("path")))


@query(
    """WITH RECURSIVE s AS (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY conv_id), w AS (SELECT conv_id || '/' || t AS url, conv_id, t, 0 AS depth FROM s
UNION ALL SELECT w.conv_id || '/' || (w.t + 1), w.conv_id, w.t + 1, depth + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.t WHERE depth < 3)
SELECT url, min(depth) AS depth FROM w GROUP BY url"""
)
def bfs_frontier(spark, sf_dir):
    """What three steps along conversations reach from their beginnings, first discovery first."""
    chat = table(spark, sf_dir, "conversations")
    at = lambda t: F.concat_ws("/", "conv_id", t)
    edges = chat.select(at(F.col("turn")).alias("src"), at(F.col("turn") + 1).alias("dst"))
    start = chat.groupBy("conv_id").agg(F.min("turn").alias("t")).select(at(F.col("t")).alias("url"))
    return crawl.breadth_first(start, edges, 3)


@query(
    """WITH n AS (SELECT conv_id AS c, conv_id * 1000 + turn AS ord, conv_id || '/' || turn AS url, conv_id || '/' || (turn - 1) AS parent_url, turn AS depth FROM conversations)
SELECT a.ord, a.url, a.depth, min(b.ord) AS parent_ord FROM n a LEFT JOIN n b ON a.parent_url = b.url AND a.depth = b.depth + 1 GROUP BY ALL"""
)
def tree_by_parent(spark, sf_dir):
    """Nodes with the first node of their parent's URL one level up (turns below the turns before)."""
    chat = table(spark, sf_dir, "conversations")
    nodes = chat.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat_ws("/", "conv_id", "turn").alias("url"), F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("parent_url"), F.col("turn").alias("depth"))
    return crawl.parents_by_url(nodes).drop("parent_url")


@query("SELECT doc_id, trim(left(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', ' ', 'g')), 50)) AS label FROM documents")
def relabel(spark, sf_dir):
    """Clean labels of at most 50 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(tx.clean_label(F.col("text"))).alias("label"))
