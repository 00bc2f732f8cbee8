"""Building blocks of the queries' SQL."""

from ..functions.text import STOPWORDS
from ..sources.tables import QA_SQL

STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), '-', ''), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda w: w <> ''))"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\s+'), lambda w: w <> '')"


def keywords(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: length(w) > 2 AND w NOT IN ({STOPS}))"


#: The default lemma and stem of a word.
STEM = "regexp_replace({w}, '(ies|es|s)$', '')"


def stems(x: str) -> str:
    return f"list_distinct(list_transform({words(x)}, lambda w: {STEM.format(w='w')}))"


def lemmas(x: str) -> str:
    return rf"list_distinct(list_filter(list_transform(regexp_extract_all(left(lower(coalesce({x}, '')), 2000), '[\p{{L}}\p{{N}}_]+'), lambda w: {STEM.format(w='w')}), lambda w: length(w) > 2))"


def ascii_words(x: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace({norm(x)}, '[^a-z0-9 ]', '', 'g'), ' '), lambda w: w <> ''))"


def like(a: str, b: str) -> str:
    return f"(1 - coalesce(levenshtein({a}, {b}) / nullif(greatest(length({a}), length({b})), 0), 0))"


def fuzzy(name: str, pairs: str) -> str:
    """CTEs: likeness of spelling (name: query_id, idx, score) of the pairs of a CTE."""
    n = name
    return f"""{n}_y AS (SELECT query_id, idx, {ascii_words('query')} AS q, {ascii_words('question')} AS d FROM {pairs} JOIN ask USING (query_id) JOIN qa USING (idx)),
{n}_z AS (SELECT query_id, idx, array_to_string(list_sort(list_intersect(q, d)), ' ') AS c, array_to_string(list_sort(list_filter(q, lambda w: NOT list_contains(d, w))), ' ') AS qo, array_to_string(list_sort(list_filter(d, lambda w: NOT list_contains(q, w))), ' ') AS dn FROM {n}_y),
{n}_s AS (SELECT query_id, idx, c, trim(c || ' ' || qo) AS one, trim(c || ' ' || dn) AS two FROM {n}_z),
{n} AS (SELECT query_id, idx, round(CASE WHEN c = '' THEN 0 ELSE greatest({like('c', 'one')}, {like('c', 'two')}, {like('one', 'two')}) END, 6) AS score FROM {n}_s)"""


def ngrams(x: str) -> str:
    s = f"replace(lower(coalesce({x}, '')), ' ', '')"
    return f"list_distinct(list_filter(list_transform(range(1, greatest(length({s}) - 1, 2)), lambda i: substr({s}, i, 3)), lambda g: length(g) = 3))"


def encode(x: str) -> str:
    dims = f"list_transform({tokens(x)}, lambda w: CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) % 64)"
    return f"list_transform(range(0, 64), lambda d: CAST(len(list_filter({dims}, lambda y: y = d)) AS DOUBLE))"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 6)"


def shared(name: str, items, text: str = "question") -> str:
    """CTEs: pairs of query and document that share an item, with the sizes of both sets."""
    return f"""{name}_q AS (SELECT query_id, {items('query')} AS s FROM ask), {name}_d AS (SELECT idx, {items(text)} AS s FROM qa),
{name}_qi AS (SELECT query_id, len(s) AS nq, unnest(s) AS item FROM {name}_q), {name}_di AS (SELECT idx, len(s) AS nd, unnest(s) AS item FROM {name}_d),
{name} AS (SELECT query_id, idx, count(*) AS inter, any_value(nq) AS nq, any_value(nd) AS nd FROM {name}_qi JOIN {name}_di USING (item) GROUP BY ALL)"""


def bm25(name: str = "bm25", keep: str = "true", docs: str = "SELECT idx, question || ' ' || answer AS text FROM qa") -> str:
    return f"""{name}_docs AS ({docs}), {name}_t AS (SELECT idx, {tokens('text')} AS t FROM {name}_docs),
{name}_post AS (SELECT token, idx, dl, count(*) AS tf FROM (SELECT idx, len(t) AS dl, unnest(t) AS token FROM {name}_t) GROUP BY ALL),
{name}_size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
{name}_raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM {name}_post GROUP BY token), {name}_size),
{name}_idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_raw) ELSE raw END AS idf FROM {name}_raw),
{name}_ask AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS token FROM ask) WHERE {keep} GROUP BY ALL),
{name} AS (SELECT query_id, idx, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_ask JOIN {name}_idf USING (token) JOIN {name}_post USING (token), {name}_size GROUP BY ALL)"""


def semantic(name: str, text: str) -> str:
    return f"""{name}_q AS (SELECT query_id, {encode('query')} AS v FROM ask), {name}_d AS (SELECT idx, {encode(text)} AS v FROM qa),
{name} AS (SELECT query_id, idx, {cosine('q.v', 'd.v')} AS score FROM {name}_q q, {name}_d d WHERE list_sum(q.v) > 0 AND list_sum(d.v) > 0)"""


def ranked(source: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM {source}) WHERE rank <= {k}"


def with_qa(*parts: str) -> str:
    return "WITH " + ",\n".join([QA_SQL, *parts])
