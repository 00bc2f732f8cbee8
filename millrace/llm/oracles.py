"""SQL for the queries that it can express."""

from __future__ import annotations

from . import secrets

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = f"""WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256 FROM n WINDOW g AS (PARTITION BY norm)"""


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UP}', '{LOW}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"


OP10 = rf"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda k: array_to_string(w[k:k + 12], ' '))) AS win FROM i WHERE len(w) > 0),
own AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, own.n, pos, item FROM (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS win FROM own) own JOIN win ON own.win = win.win AND own.n = win.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: str, pattern: str, keep: str) -> str:
    p = _quoted(pattern)
    return f"""{kind} AS (SELECT doc_id, '{kind}' AS kind, {list(secrets.KINDS).index(kind)} AS rank, stop - length(hit) AS s, stop AS e FROM (
  SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (
  SELECT doc_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS hits, regexp_split_to_array(text, {p}) AS gaps FROM t))) WHERE {keep})"""


_DONE = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank)"
_RUN = "[A-Za-z0-9+/_=-]+"  # SQL's patterns have no look-behind: a weak secret is a whole run of forty fitting characters
OP1 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_spans('assign', secrets.ASSIGN, f"length(regexp_extract(hit, {_quoted(secrets.ASSIGN)}, 1)) >= 8")},
{_spans('access', secrets.ACCESS, 'true')}, {_spans('hex', secrets.HEX, 'true')},
{_spans('weak_id', secrets.WEAK_ID, 'true')}, {_spans('weak_secret', _RUN, "length(hit) = 40 AND regexp_full_match(hit, '[A-Za-z0-9+/]+')")}, {_spans('endpoint', secrets.ENDPOINT, 'true')},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
weak AS (SELECT * FROM (SELECT * FROM weak_id UNION ALL SELECT * FROM weak_secret UNION ALL SELECT * FROM endpoint) w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
part AS (SELECT *, CASE WHEN kind IN ('access', 'weak_id') THEN 'id' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (SELECT doc_id, kind, rank, s, e FROM weak w WHERE (kind = 'weak_secret' OR EXISTS (SELECT 1 FROM part p WHERE p.doc_id = w.doc_id AND p.role = 'secret' AND abs(p.s - w.s) <= {secrets.SCOPE}))
  AND (kind = 'weak_id' OR EXISTS (SELECT 1 FROM part p WHERE p.doc_id = w.doc_id AND p.role = 'id' AND abs(p.s - w.s) <= {secrets.SCOPE}))),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {_DONE} AS base FROM base GROUP BY doc_id),
b AS (SELECT doc_id, {_DONE} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": OP1, "op2_exact_dedup": OP2, "op10_decontaminate": OP10}
