"""DuckDB SQL of the training-data queries that SQL can express."""

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_P2 = rf"""
WITH n AS (SELECT lower(trim(regexp_replace(query_text, '{_SPACE}', ' ', 'g'))) AS query_text FROM query_logs)
SELECT query_text, count(*) AS "count" FROM n WHERE query_text <> ''
GROUP BY query_text HAVING count(*) >= 5 AND count(*) >= 0.002 * (SELECT count(*) FROM query_logs)
"""

_P6 = r"""
WITH sited AS (
  SELECT i.item_id, i.normalized_url AS url, i.content, p.source_site FROM page_items i JOIN pages p ON i.normalized_url = p.normalized_url
  WHERE p.source_site IS NOT NULL AND p.source_site <> ''),
lines AS (
  SELECT DISTINCT source_site, url, regexp_replace(regexp_replace(regexp_replace(l, '[ \t\x{a0}\x{3000}]+', ' ', 'g'), '^[ \r\f\v]+|[ \r\f\v]+$', '', 'g'), '[0-9]+', '#', 'g') AS line
  FROM (SELECT source_site, url, unnest(string_split(content, chr(10))) AS l FROM sited)),
per_site AS (SELECT source_site, count(DISTINCT url) AS n FROM sited GROUP BY source_site),
found AS (
  SELECT source_site, line FROM lines JOIN per_site USING (source_site) WHERE line <> ''
  GROUP BY source_site, line, n HAVING count(*) >= 5 AND count(*) >= 0.03 * n)
"""

_P1 = r"""
WITH t AS (
  SELECT item_id, lower(regexp_replace(content, '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) AS s
  FROM page_items WHERE length(content) >= 200),
g AS (SELECT DISTINCT item_id, substr(s, CAST(i AS BIGINT), 5) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 3)) AS i FROM t)),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
shared AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.item_id < b.item_id GROUP BY 1, 2),
links AS (SELECT a, b, k / (x.n + y.n - k) AS j FROM shared JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE k / (x.n + y.n - k) >= 0.7)
"""

_P1_GROUPS = (
    _P1.replace("WITH t AS", "WITH RECURSIVE t AS")
    + """,
e AS (SELECT a, b, j FROM links UNION ALL SELECT b, a, j FROM links),
cls AS (SELECT item_id, least(item_id, coalesce(min(b) FILTER (j = 1), item_id)) AS c, 1 + count(*) FILTER (j = 1) AS n_copies FROM n LEFT JOIN e ON a = item_id GROUP BY item_id),
deg AS (SELECT a, count(DISTINCT c) AS n_links FROM e JOIN cls ON item_id = b WHERE j < 1 GROUP BY a),
reach(a, b) AS (SELECT item_id, item_id FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT item_id, (SELECT min(b) FROM reach r WHERE r.a = cls.item_id) AS group_id, coalesce(n_links, 0) AS n_links, n_copies FROM cls LEFT JOIN deg ON deg.a = item_id
UNION ALL SELECT item_id, min(item_id) OVER w, 0, count(*) OVER w FROM page_items WHERE content IS NOT NULL AND item_id NOT IN (SELECT item_id FROM n) WINDOW w AS (PARTITION BY content)
UNION ALL SELECT item_id, item_id, 0, 1 FROM page_items WHERE content IS NULL
"""
)

_P9 = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS s FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, substr(s, k, 40) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 38)) AS k FROM d WHERE length(s) >= 40)),
iw AS (SELECT DISTINCT item_id, substr(s, k, 40) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 38)) AS k FROM i WHERE length(s) >= 40))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
"""

SQL: dict[str, str] = {
    "p9_found": _P9,
    "p1_found": _P1 + "SELECT a AS item_id_a, b AS item_id_b FROM links",
    "p1_groups": _P1_GROUPS,
    "p2_found": f"SELECT query_text FROM ({_P2})",
    "p2_intervals": f'SELECT query_text, "count", true AS held FROM ({_P2})',
    "p6_found": _P6 + "SELECT source_site, line FROM found",
    "p6_cleaned": _P6
    + r""", raw AS (SELECT i.item_id, p.source_site, unnest(string_split(content, chr(10))) AS l, unnest(range(len(string_split(content, chr(10))))) AS pos
  FROM page_items i LEFT JOIN (SELECT normalized_url, source_site FROM pages WHERE source_site <> '') p ON p.normalized_url = i.normalized_url WHERE content IS NOT NULL),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(l, '[ \t\x{a0}\x{3000}]+', ' ', 'g'), '^[ \r\f\v]+|[ \r\f\v]+$', '', 'g'), '[0-9]+', '#', 'g') AS line FROM raw),
k AS (SELECT n.*, f.line IS NULL AS keep FROM n LEFT JOIN found f ON f.source_site = n.source_site AND f.line = n.line),
r AS (SELECT item_id, coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (keep), '') AS content, count(*) FILTER (NOT keep) AS removed FROM k GROUP BY item_id)
SELECT i.item_id, CASE WHEN i.content IS NULL THEN NULL ELSE r.content END AS content, coalesce(r.removed, 0) AS removed FROM page_items i LEFT JOIN r USING (item_id)""",
}
