"""DuckDB SQL of the engine's queries."""

from __future__ import annotations

from brinewell.functions.text import STOP_WORDS, query_terms
from brinewell.operators.index import K1, B
from brinewell.operators.ranking import VSM_WEIGHTS
from brinewell.operators.search import DOCUMENT_BOOSTS, PAGE_BOOSTS, RELATED_BOOSTS
from brinewell.plans.bindings import AS_OF, KEYWORDS, SITES
from brinewell.plans.queries import PHRASE, Q

_NOW = f"TIMESTAMP '{AS_OF.isoformat(sep=' ')}'"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _pairs(run: str) -> str:
    return f"CASE WHEN length({run}) = 1 THEN [{run}] ELSE [substr({run}, i, 2) for i in range(1, length({run}))] END"


def _tokens(c: str) -> str:
    parts = rf"regexp_extract_all(coalesce({c}, ''), '[\x{{4e00}}-\x{{9fff}}]+|[a-zA-Z0-9]+')"
    return f"list_filter(flatten([CASE WHEN regexp_matches(p, '^[a-zA-Z0-9]') THEN [lower(p)] ELSE {_pairs('p')} END for p in {parts}]), lambda x: NOT list_contains({_STOP}, x))"


_ITEMS = """items AS (
  SELECT normalized_url, coalesce(content, '') AS content, coalesce(array_to_string(anchor_texts, ' '), '') AS anchor_text
  FROM (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY item_id DESC) AS rn FROM page_items WHERE normalized_url IS NOT NULL AND normalized_url <> '') WHERE rn = 1)"""
_PAGE_DOCS = f"""{_ITEMS},
docs AS (SELECT p.id AS doc_id, p.url, coalesce(p.title, '') AS title, coalesce(i.content, '') AS content, coalesce(i.anchor_text, '') AS anchor_text, p.source_site, p.category
  FROM pages p LEFT JOIN items i ON i.normalized_url = p.normalized_url)"""
_ATTACHMENT_DOCS = """docs AS (SELECT a.id AS doc_id, a.file_url, coalesce(a.file_name, '') AS file_name, a.file_type, coalesce(t.text, '') AS file_text, a.parent_page_id,
  coalesce(a.parent_title, '') AS parent_title, a.source_site, a.category FROM attachments a LEFT JOIN documents t ON t.doc_id = a.id)"""


def _fields(fields: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {_tokens(f)} AS toks FROM docs" for f in fields)
    return f"""fields AS (SELECT * FROM ({union}) WHERE len(toks) > 0),
stats AS (SELECT field, cast(count(*) AS DOUBLE) AS n, cast(sum(len(toks)) AS DOUBLE) / count(*) AS av FROM fields GROUP BY field)"""


def _list(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _case(boosts: dict[str, float]) -> str:
    return "CASE field " + " ".join(f"WHEN '{f}' THEN cast({b} AS DOUBLE)" for f, b in boosts.items()) + " END"


_TF = f"tf / (tf + cast({K1} AS DOUBLE) * (cast({1 - B} AS DOUBLE) + cast({B} AS DOUBLE) * dl / av))"
_IDF = "ln(cast(1 AS DOUBLE) + (n - df + cast(0.5 AS DOUBLE)) / (df + cast(0.5 AS DOUBLE)))"


def _multi(docs: str, q: str, boosts: dict[str, float]) -> str:
    terms = list(dict.fromkeys(query_terms(q, in_order=True)))
    return f"""{docs},
{_fields(list(boosts))},
tfs AS (SELECT doc_id, field, len(toks) AS dl, t AS term, cast(len(list_filter(toks, lambda x: x = t)) AS DOUBLE) AS tf FROM (SELECT *, unnest({_list(terms)}) AS t FROM fields)),
dfs AS (SELECT field, term, cast(count(*) AS DOUBLE) AS df FROM tfs WHERE tf > 0 GROUP BY ALL),
bm AS (SELECT doc_id, field, sum({_IDF} * {_TF}) AS s FROM tfs JOIN dfs USING (field, term) JOIN stats USING (field) WHERE tf > 0 GROUP BY ALL),
hits AS (SELECT doc_id, max({_case(boosts)} * s) AS score FROM bm GROUP BY doc_id)"""


def _phrase(q: str, boosts: dict[str, float]) -> str:
    terms = query_terms(q, in_order=True)
    m = len(terms)
    return f"""{_PAGE_DOCS},
{_fields(list(boosts))},
tfs AS (SELECT doc_id, field, len(toks) AS dl, cast(len([i for i in range(1, len(toks) - {m} + 2) if toks[i : i + {m - 1}] = {_list(terms)}]) AS DOUBLE) AS tf FROM fields),
dfs AS (SELECT field, t AS term, cast(count(*) AS DOUBLE) AS df FROM (SELECT field, unnest({_list(terms)}) AS t, toks FROM fields) WHERE list_contains(toks, t) GROUP BY ALL),
idf AS (SELECT field, sum({_IDF}) AS idf FROM dfs JOIN stats USING (field) GROUP BY field),
hits AS (SELECT doc_id, sum({_case(boosts)} * idf * {_TF}) AS score FROM tfs JOIN idf USING (field) JOIN stats USING (field) WHERE tf > 0 GROUP BY doc_id)"""


def _top(n: int, offset: int = 0) -> str:
    return f"top AS (SELECT d.*, h.score FROM hits h JOIN docs d USING (doc_id) ORDER BY score DESC, doc_id LIMIT {n} OFFSET {offset})"


def _vsm(q: str) -> str:
    terms = query_terms(q)
    own = {t: terms.count(t) / len(terms) for t in dict.fromkeys(terms)}
    stop = f"lambda x: NOT list_contains({_STOP}, x)"
    union = " UNION ALL ".join(
        f"""SELECT doc_id, '{f}' AS field, cast({w} AS DOUBLE) AS weight, list_filter(list_concat(flatten([{_pairs('r')} for r in regexp_extract_all(coalesce({f}, ''), '[\\x{{4e00}}-\\x{{9fff}}]+')]),
  [lower(w) for w in regexp_extract_all(coalesce({f}, ''), '[a-zA-Z0-9]+')]), {stop}) AS toks FROM top"""
        for f, w in VSM_WEIGHTS.items()
    )
    rows = ", ".join(f"('{t}', cast({v!r} AS DOUBLE))" for t, v in own.items())
    return f"""qt AS (SELECT * FROM (VALUES {rows}) AS v(term, q_tf)),
vf AS ({union}),
vt AS (SELECT doc_id, field, weight, term, cast(count(*) AS DOUBLE) / any_value(l) AS tf FROM (SELECT doc_id, field, weight, len(toks) AS l, unnest(toks) AS term FROM vf) GROUP BY doc_id, field, weight, term),
vn AS (SELECT cast(count(*) + 1 AS DOUBLE) AS nd FROM top),
vd AS (SELECT field, term, count(*) AS df FROM vt GROUP BY ALL),
vi AS (SELECT field, term, coalesce(q_tf, cast(0 AS DOUBLE)) AS q_tf, ln((nd + 1) / (df + CASE WHEN q_tf > 0 THEN 1 ELSE 0 END + 1)) + 1 AS idf FROM vd CROSS JOIN vn LEFT JOIN qt USING (term)),
vq AS (SELECT f.field, sqrt(sum(pow(q_tf * (ln((nd + 1) / (coalesce(df, 0) + 2)) + 1), 2))) AS q_norm FROM (SELECT unnest({_list(list(VSM_WEIGHTS))}) AS field) f CROSS JOIN qt CROSS JOIN vn LEFT JOIN vd ON vd.field = f.field AND vd.term = qt.term GROUP BY f.field),
vc AS (SELECT doc_id, field, weight, sum(tf * idf * q_tf * idf) AS dot, sqrt(sum(pow(tf * idf, 2))) AS norm FROM vt JOIN vi USING (field, term) GROUP BY ALL),
vs AS (SELECT doc_id, sum(weight * coalesce(dot / nullif(norm * q_norm, 0), 0)) AS s FROM vc JOIN vq USING (field) GROUP BY doc_id),
va AS (SELECT t.doc_id, coalesce(s, 0) AS s FROM top t LEFT JOIN vs USING (doc_id)),
vsm AS (SELECT doc_id, coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), cast(0 AS DOUBLE)) AS vsm FROM va)"""


def _alternatives(terms: list[str]) -> str:
    return "|".join(sorted(set(terms), key=lambda t: (-len(t), t)))


def _marked(x: str, terms: list[str]) -> str:
    return f"regexp_replace({x}, '(?i)({_alternatives(terms)})', '<em>\\1</em>', 'g')"


def _sane(x: str) -> str:
    kept = f"replace(replace({x}, '<em>', chr(1)), '</em>', chr(2))"
    return f"replace(replace(regexp_replace({kept}, '<[^>]*>', '', 'g'), chr(1), '<em>'), chr(2), '</em>')"


def _snippets(source: str, column: str, terms: list[str]) -> str:
    c = f"coalesce({column}, '')"
    return f"""parts AS (SELECT doc_id, i, substr(c, i * 150 + 1, 150) AS part FROM (SELECT doc_id, {c} AS c, unnest(range(0, cast(greatest((length({c}) - 1) // 150, 0) AS BIGINT) + 1)) AS i FROM {source})),
hit AS (SELECT *, len(regexp_extract_all(part, '(?i)({_alternatives(terms)})')) AS n FROM parts),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS rn FROM hit),
sn AS (SELECT doc_id, string_agg({_marked('part', terms)}, ' ... ' ORDER BY rn) FILTER (rn <= 3 AND n > 0) AS s FROM rk GROUP BY doc_id)"""


_KW = "kw AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{k}', cast({w} AS DOUBLE))" for r, k, w in KEYWORDS) + ") AS v(role, keyword, weight))"


def _preference(snippet: str) -> str:
    t, s, c = "lower(coalesce(title, ''))", f"lower({snippet})", "lower(coalesce(category, ''))"
    n = lambda x: f"len(list_filter(coalesce(interests, []), lambda y: y IS NOT NULL AND y <> '' AND contains({x}, lower(y))))"
    return f"""round(coalesce((SELECT sum(CASE WHEN contains({t}, lower(keyword)) THEN 2.0 * weight ELSE 0 END + CASE WHEN contains({s}, lower(keyword)) THEN 0.5 * weight ELSE 0 END) FROM kw WHERE kw.role = u.role), 0)
  + CASE WHEN coalesce(college, '') <> '' AND contains(coalesce(title, ''), college) THEN 2.0 ELSE 0 END
  + CASE WHEN coalesce(college, '') <> '' AND (contains({snippet}, college) OR contains(coalesce(source_site, ''), college)) THEN 0.5 ELSE 0 END
  + cast(2.0 AS DOUBLE) * {n(t)} + cast(0.5 AS DOUBLE) * {n(s)} + cast(1.5 AS DOUBLE) * {n(c)}, 4)"""


_NORM_BASE = r"regexp_replace(regexp_extract({u}, '^([^?#]*)', 1), '([^:/])/+$', '\1')"


def _norm(u: str) -> str:
    base = _NORM_BASE.format(u=u)
    return rf"CASE WHEN regexp_matches({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$') THEN {base} || '/' ELSE {base} END || regexp_extract({u}, '^[^?#]*([?][^#]*)', 1)"


def _host(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


_LOGS = "query_logs"
_TYPES = ("fulltext", "phrase", "wildcard", "document")

_P7 = rf"""
hosts AS (SELECT DISTINCT lower(source_site) AS host FROM pages WHERE source_site IS NOT NULL AND source_site <> ''),
l AS (SELECT id, created_at, {_norm('to_url')} AS target FROM page_links WHERE to_url IS NOT NULL),
p AS (SELECT normalized_url AS k, min(created_at) AS born FROM pages GROUP BY 1),
q AS (SELECT id AS k, min(created_at) AS born FROM query_logs GROUP BY 1),
i AS (SELECT id AS k, min(created_at) AS born FROM pages GROUP BY 1),
r AS (
  SELECT 'page_links' AS table_name, l.id AS row_id, l.created_at, p.k, p.born FROM l JOIN hosts ON hosts.host = lower({_host('target')}) LEFT JOIN p ON p.k = l.target
  UNION ALL SELECT 'click_logs', c.id, c.created_at, q.k, q.born FROM click_logs c LEFT JOIN q ON q.k = c.query_log_id WHERE c.query_log_id IS NOT NULL
  UNION ALL SELECT 'attachments', a.id, a.created_at, i.k, i.born FROM attachments a LEFT JOIN i ON i.k = a.parent_page_id WHERE a.parent_page_id IS NOT NULL),
found AS (SELECT DISTINCT table_name, row_id, strftime(created_at, '%Y-%m') AS period, CASE WHEN k IS NULL THEN 'missing' ELSE 'late' END AS kind FROM r WHERE k IS NULL OR born > created_at)"""

_DECIDE = """
incoming AS (SELECT item_id AS line_no, normalized_url, title, content_hash, category, CASE WHEN trim(normalized_url) <> '' THEN normalized_url END AS k FROM page_items),
known AS (SELECT normalized_url AS nk, max(coalesce(content_hash, '')) AS h FROM pages WHERE trim(normalized_url) <> '' GROUP BY 1),
lagged AS (SELECT i.*, nk, CASE WHEN row_number() OVER w = 1 THEN h ELSE lag(coalesce(content_hash, '')) OVER w END AS prev, row_number() OVER w AS rn
  FROM incoming i LEFT JOIN known ON k = nk WINDOW w AS (PARTITION BY coalesce(k, chr(0) || line_no) ORDER BY line_no, content_hash NULLS FIRST)),
decided AS (SELECT *, CASE WHEN k IS NULL THEN 'skip_invalid' WHEN rn = 1 AND nk IS NULL THEN 'insert' WHEN coalesce(content_hash, '') = prev AND NOT {force} THEN 'skip' ELSE 'update' END AS action FROM lagged)"""

_STATES = rf"""
links AS (SELECT i.item_id, generate_subscripts(attachment_links, 1) - 1 AS pos, unnest(attachment_links) AS file_url FROM page_items i),
f AS (SELECT l.*, {_norm('file_url')} AS nk, l.item_id % 7 <> 0 AS downloaded, t.text FROM links l LEFT JOIN documents t ON t.doc_id = l.item_id WHERE file_url IS NOT NULL),
known AS (SELECT normalized_file_url AS k, max(CASE WHEN parse_status = 'indexed' THEN 1 ELSE 0 END) AS indexed FROM attachments GROUP BY 1),
states AS (SELECT item_id, pos, CASE WHEN NOT (regexp_matches(file_url, '(?i)^https?://') AND regexp_matches(file_url, '(?i)\.(pdf|docx|xlsx)$')) THEN 'ignored'
  WHEN indexed = 1 THEN 'skip' WHEN NOT downloaded THEN CASE WHEN k IS NOT NULL THEN 'download_failed' ELSE 'failed_new' END
  WHEN coalesce(trim(text), '') = '' THEN 'parse_failed' ELSE 'indexed' END AS step FROM f LEFT JOIN known ON k = nk)"""

# what the reports compare with is written out here once more, apart from the engine's own lists
_SKIP = r"css|js|png|jpg|jpeg|gif|svg|ico|woff2?|ttf|eot|mp4|mp3|webp|bmp|pdf|docx?|xlsx?|pptx?|zip|rar|7z|tar|gz"
_STEPS = r"/(search|login|logout|register|user|admin|wp-admin|wp-json|api|feed|rss|comment|reply|trackback|tag/|category/|author/|page/\d+|date/)\b|\$\[|nextcid="


def _skipped(u: str) -> str:
    uploads = f"regexp_replace({u}, '(?i)/wp-content/uploads', '/', 'g')"
    return rf"(regexp_matches({u}, '(?i){_STEPS}') OR regexp_matches({uploads}, '(?i)/wp-content/\b'))"


def _new_links(links: str) -> str:
    """New addresses of rows (url, href), hrefs absolute, from the host's root, or relative to the address."""
    return rf"""h AS (SELECT url, trim(href) AS href FROM ({links}) WHERE url IS NOT NULL AND trim(href) <> '' AND regexp_matches(trim(href), '^[\x00-\x7f]') AND NOT regexp_matches(trim(href), '(?i)^(javascript:|mailto:|tel:|#)')),
u AS (SELECT DISTINCT CASE WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-z]+:', 0) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || href ELSE regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*/', 0) || href END AS u FROM h),
k AS (SELECT DISTINCT {_norm('u')} AS url FROM u WHERE regexp_matches(u, '(?i)^https?://') AND regexp_replace(lower({_host('u')}), '^www\.', '') IN ('news.yunheng.example', 'lib.yunheng.example', 'jwc.yunheng.example')
  AND NOT regexp_matches(u, '(?i)\.({_SKIP})$') AND NOT {_skipped('u')})"""


_HREFS = r"SELECT {url} AS url, regexp_extract(unnest(regexp_extract_all(raw_html, '(?is)<a\s[^>]*?href=\"[^\"]*\"[^>]*>.*?</a>')), '(?i)href=\"([^\"]*)\"', 1) AS href FROM page_items WHERE raw_html IS NOT NULL"

_GRAPH = [
    f"pe AS (SELECT DISTINCT {_norm('from_url')} AS src, {_norm('to_url')} AS dst FROM page_links), pf AS (SELECT * FROM pe WHERE src <> dst)",
    "pv AS (SELECT src AS v FROM pf UNION SELECT dst FROM pf), pn AS (SELECT cast(count(*) AS DOUBLE) AS nodes FROM pv), pd AS (SELECT src, count(*) AS deg FROM pf GROUP BY src), pw AS (SELECT pf.src, pf.dst, pd.deg FROM pf JOIN pd USING (src))",
    "r0 AS (SELECT v, 1 / nodes AS r FROM pv, pn)",
] + [
    f"""r{k} AS (SELECT v, cast(0.15 AS DOUBLE) / nodes + cast(0.85 AS DOUBLE) * (coalesce(got, 0) + lost / nodes) AS r FROM pv LEFT JOIN (SELECT dst AS v, sum(r / deg) AS got FROM pw JOIN r{k - 1} ON v = src GROUP BY dst) USING (v), pn,
  (SELECT coalesce(sum(r), 0) AS lost FROM r{k - 1} WHERE v NOT IN (SELECT src FROM pd)))"""
    for k in range(1, 6)
]


def _scan(text: str, fractions: str, only: tuple[int, ...] = range(7)) -> str:
    """The first date of a text, in the order of the spellings."""
    day, time = r"\d{{4}}{a}\d{{1,2}}{b}\d{{1,2}}{c}", r"\d{1,2}:\d{1,2}"
    dash, slash, han = (day.format(a=a, b=a, c=c) for a, c in (("-", ""), ("/", ""), ("", "")))
    han = r"\d{4}年\d{1,2}月\d{1,2}日"
    spellings = [(dash + r"\s+" + time + r":\d{1,2}", "%Y-%m-%d %H:%M:%S"), (dash + r"\s+" + time, "%Y-%m-%d %H:%M"), (dash, "%Y-%m-%d"), (slash + r"\s+" + time, "%Y/%m/%d %H:%M"), (slash, "%Y/%m/%d"), (han + r"\s*" + time, "%Y年%m月%d日 %H:%M"), (han, "%Y年%m月%d日")]
    one = lambda find, read: f"try_strptime(regexp_replace(regexp_replace(nullif(regexp_extract({text}, '{find}', 0), ''), '\\s+', ' ', 'g'), '日 ?(\\d)', '日 \\1'), '{read}')"
    return f"strftime(coalesce({', '.join(one(*spellings[i]) for i in only)}), '{fractions}')"


_TEXT = r"regexp_replace(regexp_replace(raw_html, '(?is)<(script|style)\b.*?(</(script|style)\s*>|$)|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TITLE = r"nullif(trim(regexp_replace(regexp_replace(regexp_extract(raw_html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '')"
_SITES = "sites AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}', {_list(d)}, {_list(u)}, {n})" for s, c, d, u, n in SITES) + ") AS v(site, category, domains, start_urls, max_pages))"
_ATTACHED = rf"""
incoming AS (SELECT i.item_id, pos, i.title, {_norm('u')} AS nk, sha256(t.text) AS content_hash FROM (SELECT item_id, title, unnest(attachment_links) AS u, generate_subscripts(attachment_links, 1) - 1 AS pos FROM page_items) i
  LEFT JOIN documents t ON t.doc_id = i.item_id WHERE u IS NOT NULL),
known AS (SELECT normalized_file_url AS k, max(coalesce(content_hash, '')) AS h FROM attachments WHERE trim(normalized_file_url) <> '' GROUP BY 1),
lagged AS (SELECT i.*, k, CASE WHEN row_number() OVER w = 1 THEN h ELSE lag(coalesce(content_hash, '')) OVER w END AS prev, row_number() OVER w AS rn
  FROM incoming i LEFT JOIN known ON k = nk WINDOW w AS (PARTITION BY nk ORDER BY item_id, pos)),
decided AS (SELECT *, CASE WHEN rn = 1 AND k IS NULL THEN 'insert' WHEN coalesce(content_hash, '') = prev THEN 'skip' ELSE 'update' END AS action FROM lagged)"""

SQL: dict[str, str] = {
    "p7_found": f"WITH {_P7} SELECT * FROM found",
    "p7_report": f"WITH {_P7} SELECT table_name, period, kind, count(*) AS cnt FROM found GROUP BY ALL",
    "log_stats": f"""SELECT count(*) AS total_queries, count(*) FILTER (created_at >= date_trunc('day', {_NOW})) AS today_queries,
{', '.join(f"count(*) FILTER (query_type = '{t}') AS {t}_queries" for t in _TYPES)}, (SELECT count(*) FROM users) AS total_users FROM query_logs""",
    "hot_queries_24h": f"SELECT query_text, count(*) AS cnt FROM query_logs WHERE query_type IN ('fulltext', 'phrase') AND created_at >= {_NOW} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY cnt DESC, query_text LIMIT 10",
    "hot_queries_all": "SELECT query_text, count(*) AS cnt FROM query_logs WHERE query_type IN ('fulltext', 'phrase') GROUP BY 1 ORDER BY cnt DESC, query_text LIMIT 20",
    "hot_queries_ci": "SELECT lower(query_text) AS query_text, count(*) AS cnt FROM query_logs WHERE query_type IN ('fulltext', 'phrase') GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 50",
    "suggest_prefix": "SELECT query_text, count(*) AS cnt FROM query_logs WHERE starts_with(query_text, '校') GROUP BY 1 ORDER BY cnt DESC, query_text LIMIT 10",
    "suggest_like": "SELECT query_text, count(*) AS cnt FROM query_logs WHERE query_text LIKE '_历%' GROUP BY 1 ORDER BY cnt DESC, query_text LIMIT 10",
    "recent_queries": "SELECT id, query_text, query_type, result_count, created_at FROM (SELECT DISTINCT * FROM query_logs) ORDER BY created_at DESC, id DESC LIMIT 20",
    "type_distribution": f"""WITH c AS (SELECT t AS query_type, (SELECT count(*) FROM query_logs WHERE query_type = t) AS cnt FROM (SELECT unnest({_list(list(_TYPES))}) AS t))
SELECT query_type, cnt, round(100.0 * cnt / sum(cnt) OVER ()) AS pct FROM c""",
    "daily_trend": f"""WITH c AS (SELECT strftime(created_at, '%Y-%m-%d') AS d, count(*) AS cnt FROM query_logs WHERE created_at >= {_NOW} - INTERVAL 30 DAY GROUP BY 1)
SELECT d, cnt, round(100.0 * cnt / greatest(max(cnt) OVER (), 1)) AS bar FROM c""",
    "click_through": """WITH l AS (SELECT id, min(query_type) AS query_type FROM query_logs GROUP BY id),
c AS (SELECT query_log_id, count(DISTINCT id) AS n FROM click_logs WHERE query_log_id IS NOT NULL GROUP BY 1)
SELECT query_type, count(*) AS queries, count(n) AS clicked, cast(coalesce(sum(n), 0) AS BIGINT) AS clicks FROM l LEFT JOIN c ON c.query_log_id = l.id GROUP BY 1""",
    "username_taken": "SELECT count(*) AS cnt FROM users WHERE username = 'yh_2'",
    "term_frequencies": f"""WITH {_PAGE_DOCS}, t AS (SELECT doc_id, {_tokens('content')} AS toks FROM docs), e AS (SELECT doc_id, len(toks) AS l, unnest(toks) AS term FROM t)
SELECT doc_id AS page_id, term, count(*) AS n, round(cast(count(*) AS DOUBLE) / any_value(l), 6) AS tf FROM e GROUP BY doc_id, term""",
    "document_frequencies": f"WITH {_PAGE_DOCS}, {_fields(['title', 'content'])} SELECT term, field, count(*) AS df FROM (SELECT field, unnest(list_distinct(toks)) AS term FROM fields) GROUP BY ALL",
    "field_statistics": f"WITH {_PAGE_DOCS}, {_fields(['title', 'content', 'anchor_text'])} SELECT field, count(*) AS doc_count, cast(sum(len(toks)) AS BIGINT) AS sum_dl FROM fields GROUP BY field",
    "postings": f"""WITH {_PAGE_DOCS}, {_fields(['title'])}, e AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM fields)
SELECT term, doc_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM e GROUP BY ALL""",
    "search_pages": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)}, {_top(20)} SELECT doc_id AS page_id, title, round(score, 6) AS score FROM top",
    "search_pages_all": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)} SELECT doc_id AS page_id, round(score, 6) AS score FROM hits",
    "search_pages_filtered": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)} SELECT doc_id AS page_id, round(score, 6) AS score FROM hits JOIN docs USING (doc_id) WHERE source_site = 'news.yunheng.example'",
    "search_page_two": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)}, {_top(10, 10)} SELECT doc_id AS page_id, round(score, 6) AS score FROM top",
    "search_total": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)} SELECT least(count(*), 10000) AS total FROM hits",
    "search_documents": f"WITH {_multi(_ATTACHMENT_DOCS, Q, DOCUMENT_BOOSTS)} SELECT doc_id AS attachment_id, round(score, 6) AS score FROM hits JOIN docs USING (doc_id) WHERE file_type = 'pdf'",
    "search_phrase": f"WITH {_phrase(PHRASE, {'title': 4.0, 'content': 1.0})} SELECT doc_id AS page_id, round(score, 6) AS score FROM hits",
    "search_wildcard_url": "SELECT id AS page_id, cast(1 AS DOUBLE) AS score FROM pages WHERE url LIKE 'https://news.%/info/%1_.htm'",
    "search_wildcard_title": f"SELECT id AS page_id, cast(1 AS DOUBLE) AS score FROM pages WHERE len(list_filter({_tokens('title')}, lambda t: t LIKE 'work%p')) > 0",
    "search_regex": "SELECT id AS page_id, coalesce(title, '') AS title FROM pages WHERE regexp_matches(title, '第([0-9]+)届')",
    "highlight_titles": r"""SELECT id AS page_id, replace(replace(regexp_replace(replace(replace(regexp_replace(coalesce(title, ''), '(?i)(workshop|风险)', '<em>\1</em>', 'g'), '<em>', chr(1)), '</em>', chr(2)), '<[^>]*>', '', 'g'), chr(1), '<em>'), chr(2), '</em>') AS title FROM pages""",
    "snippets": f"WITH {_PAGE_DOCS}, {_snippets('docs', 'content', ['风险评估', 'workshop'])} SELECT doc_id AS page_id, coalesce(s, substr(content, 1, 100)) AS snippet FROM docs JOIN sn USING (doc_id)",
    "page_results": f"""WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)}, {_top(10)}, {_snippets('top', 'content', query_terms(Q, in_order=True))}
SELECT doc_id AS page_id, {_sane(_marked('title', query_terms(Q, in_order=True)))} AS title, url, {_sane('coalesce(s, substr(content, 1, 100))')} AS snippet, source_site, category, round(score, 6) AS score FROM top JOIN sn USING (doc_id)""",
    "document_results": f"""WITH {_multi(_ATTACHMENT_DOCS, Q, DOCUMENT_BOOSTS)}, {_top(10)}, {_snippets('top', 'file_text', query_terms(Q, in_order=True))}
SELECT doc_id AS attachment_id, {_sane(_marked('file_name', query_terms(Q, in_order=True)))} AS file_name, file_url, file_type, {_sane('coalesce(s, substr(file_text, 1, 100))')} AS snippet, parent_page_id, parent_title, round(score, 6) AS score FROM top JOIN sn USING (doc_id)""",
    "vsm_scores": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)}, {_top(20)}, {_vsm(Q)} SELECT doc_id AS page_id, round(vsm, 6) AS vsm FROM vsm",
    "preference_scores": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)}, {_top(10)}, {_KW} SELECT u.id AS user_id, doc_id AS page_id, {_preference('substr(content, 1, 100)')} AS preference FROM users u CROSS JOIN top",
    "ranked_search": f"""WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)}, {_top(20)}, {_vsm(Q)}, {_KW}, {', '.join(_GRAPH)},
p AS (SELECT doc_id, {_preference('substr(content, 1, 100)')} AS preference FROM top CROSS JOIN (SELECT * FROM users WHERE id = 12) u)
SELECT doc_id AS page_id, round(score, 6) AS bm25, round(vsm, 4) AS vsm, round(coalesce(r, cast(0 AS DOUBLE)), 9) AS pagerank, coalesce(preference, 0) AS preference,
  round(cast(0.6 AS DOUBLE) * score + cast(0.2 AS DOUBLE) * vsm + cast(0.15 AS DOUBLE) * coalesce(r, cast(0 AS DOUBLE)) + cast(0.05 AS DOUBLE) * coalesce(preference, 0), 4) AS final_score
FROM top JOIN vsm USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN r5 ON v = {_norm('url')}""",
    "related_pages": f"""WITH {_multi(_PAGE_DOCS, '学位授予', RELATED_BOOSTS)}, {_top(5)}, {_KW}, p AS (SELECT doc_id, score, {_preference("''")} AS preference FROM top CROSS JOIN (SELECT * FROM users WHERE id = 12) u)
SELECT doc_id AS page_id, round(score + coalesce(preference, 0), 4) AS final_score FROM p""",
    "role_profiles": f"WITH {_KW} SELECT role, count(DISTINCT id) AS users, round(coalesce(sum(weight), 0), 3) AS weight FROM users LEFT JOIN kw USING (role) GROUP BY role",
    "anonymous_profile": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)}, {_top(10)} SELECT doc_id AS page_id, cast(0 AS DOUBLE) AS preference FROM top",
    "url_normalize": f"SELECT DISTINCT id, {_norm('to_url')} AS u, {_host('to_url')} AS host FROM page_links",
    "url_filters": rf"""SELECT DISTINCT id, (lower({_host('to_url')}) = 'yunheng.example' OR ends_with(lower({_host('to_url')}), '.yunheng.example')) AS below,
  regexp_replace(lower({_host('to_url')}), '^www\.', '') IN ('news.yunheng.example', 'lib.yunheng.example') AS exact, regexp_matches(to_url, '(?i)\.({_SKIP})$') AS skip_ext,
  to_url IS NOT NULL AND trim(to_url) <> '' AND regexp_matches(trim(to_url), '^[\x00-\x7f]') AND NOT regexp_matches(trim(to_url), '(?i)^(javascript:|mailto:|tel:|#)') AS href_ok,
  CASE WHEN regexp_matches(to_url, '/info/\d+/\d+\.htm') THEN 'detail' WHEN regexp_matches(to_url, '/notice/') THEN 'list' ELSE 'other' END AS kind FROM page_links""",
    "url_hashes": r"""WITH h AS (SELECT *, substr(sha256(url), 1, 16) AS s FROM pages)
SELECT id, sha256(url) AS hash, 'snapshots/' || substr(s, 1, 2) || '/' || substr(s, 3, 2) || '/' || s || '.html' AS snapshot,
  substr(md5(url), 1, 12) || CASE WHEN contains(lower(url), '.pdf') THEN '.pdf' WHEN contains(lower(url), '.docx') THEN '.docx' WHEN contains(lower(url), '.xlsx') THEN '.xlsx' ELSE '.pdf' END AS file_name,
  snapshot_path IS NOT NULL AND NOT regexp_matches(replace(snapshot_path, chr(92), '/'), '(^|/)\.\.(/|$)') AND NOT regexp_matches(replace(snapshot_path, chr(92), '/'), '^([A-Za-z]:|/)') AS safe FROM h""",
    "url_dates": r"SELECT id, cast(try_strptime(nullif(regexp_extract(regexp_replace(url, '/(\d{4})/(\d{2})(\d{2})/', '/\1/\2/\3/', 'g'), '/(\d{4}/\d{2}/\d{2})[/.]', 1), ''), '%Y/%m/%d')::DATE AS VARCHAR) AS d FROM pages",
    "parse_dates": "SELECT item_id, strftime(try_strptime(substr(publish_time, 1, 26), ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d']), '%Y-%m-%d %H:%M:%S') AS published, replace(substr(crawl_time, 1, 19), 'T', ' ') AS crawled FROM page_items",
    "stale_hashes": "SELECT item_id, sha256(content) = content_hash AS fresh, strlen(content) AS bytes, length(substr(content, 1, 2000)) AS shown FROM page_items WHERE content IS NOT NULL",
    "html_titles": r"""WITH t AS (SELECT item_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(raw_html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '') AS a,
  nullif(trim(regexp_replace(regexp_replace(regexp_extract(raw_html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '') AS b FROM page_items WHERE raw_html IS NOT NULL)
SELECT item_id, coalesce(a, b, '') AS title FROM t""",
    "html_links": r"""WITH a AS (SELECT item_id, regexp_extract_all(raw_html, '(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>') AS l FROM page_items WHERE raw_html IS NOT NULL),
e AS (SELECT item_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM a), h AS (SELECT item_id, pos, regexp_extract(x, '(?i)href="([^"]*)"', 1) AS href FROM e)
SELECT item_id, pos, href, CASE WHEN regexp_matches(href, '(?i)\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar)$') THEN 'attachment' ELSE 'page' END AS kind FROM h""",
    "link_degrees": f"""WITH e AS (SELECT DISTINCT {_norm('from_url')} AS src, {_norm('to_url')} AS dst FROM page_links), f AS (SELECT * FROM e WHERE src <> dst)
SELECT url, cast(sum(o) AS BIGINT) AS out_degree, cast(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS url, 1 AS o, 0 AS i FROM f UNION ALL SELECT dst, 0, 1 FROM f) GROUP BY url""",
    "pagerank": "WITH " + ", ".join(_GRAPH) + " SELECT v AS url, round(r, 9) AS pagerank FROM r5",
    "site_page_caps": "SELECT id, source_site FROM (SELECT *, row_number() OVER (PARTITION BY source_site ORDER BY id) AS rn FROM pages) WHERE rn <= 5",
    "crawl_stats": f"""WITH t AS (SELECT *, coalesce({_skipped('url')} OR status_code >= 400, false) AS sk FROM page_items), k AS (SELECT * FROM t WHERE NOT sk)
SELECT count(*) AS pages, round(count(*) / cast(12.5 AS DOUBLE), 1) AS pages_per_minute, round(cast(coalesce(sum(strlen(content)), 0) AS DOUBLE) / greatest(count(*), 1), 1) AS mean_bytes,
  cast(coalesce(sum(coalesce(len(attachment_links), 0)), 0) AS BIGINT) AS attachments, count(*) FILTER (coalesce(trim(content), '') = '') AS empty_pages, (SELECT count(*) FROM t WHERE sk) AS skipped FROM k""",
    "site_yield": "WITH c AS (SELECT source_site AS site, count(*) AS cnt FROM page_items GROUP BY 1) SELECT site, cnt, round(100.0 * cnt / max(cnt) OVER ()) AS pct FROM c",
    "ingest_decide": f"WITH {_DECIDE.format(force='false')} SELECT line_no, action FROM decided",
    "ingest_force": f"WITH {_DECIDE.format(force='true')} SELECT 'page' AS entity, action, count(*) AS cnt FROM decided GROUP BY action",
    "ingest_stats": f"WITH {_DECIDE.format(force='false')} SELECT 'page' AS entity, action, count(*) AS cnt FROM decided GROUP BY action",
    "ingest_upsert": f"""WITH {_DECIDE.format(force='false')}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY line_no DESC) AS r2 FROM decided WHERE action IN ('insert', 'update')) WHERE r2 = 1)
SELECT coalesce(p.normalized_url, l.normalized_url) AS normalized_url, CASE WHEN l.k IS NULL THEN p.title WHEN p.id IS NULL THEN coalesce(l.title, '') ELSE l.title END AS title,
  CASE WHEN l.k IS NULL THEN p.content_hash WHEN p.id IS NULL THEN coalesce(l.content_hash, '') ELSE l.content_hash END AS content_hash,
  CASE WHEN l.k IS NULL THEN p.category WHEN p.id IS NULL THEN coalesce(l.category, '') ELSE l.category END AS category, coalesce(l.action, 'keep') AS action
FROM pages p FULL JOIN last l ON l.normalized_url = p.normalized_url""",
    "ingest_new_ids": f"""WITH {_DECIDE.format(force='false')}, new AS (SELECT normalized_url, min(line_no) AS first_line FROM decided WHERE action = 'insert' GROUP BY 1)
SELECT (SELECT max(id) FROM pages) + row_number() OVER (ORDER BY first_line) AS id, normalized_url, first_line FROM new""",
    "ingest_reindexed": f"WITH {_DECIDE.format(force='false')} SELECT normalized_url, max(line_no) AS last_line FROM decided WHERE action IN ('insert', 'update') GROUP BY 1",
    "ingest_dry_run": "SELECT CASE WHEN normalized_url IS NULL OR trim(normalized_url) = '' THEN 'fail' ELSE 'insert' END AS action, count(*) AS cnt FROM page_items GROUP BY 1",
    "dedupe_content": "SELECT sha256(content) AS hash, count(*) AS cnt, min(item_id) AS first_id FROM page_items WHERE content <> '' GROUP BY 1 HAVING count(*) > 1",
    "attachment_states": f"WITH {_STATES} SELECT * FROM states",
    "attachment_stats": f"""WITH {_STATES} SELECT count(*) FILTER (step <> 'ignored') AS found, count(*) FILTER (step IN ('download_failed', 'failed_new', 'parse_failed', 'indexed')) AS "new", count(*) FILTER (step = 'skip') AS skipped,
  count(*) FILTER (step IN ('parse_failed', 'indexed')) AS downloaded, count(*) FILTER (step IN ('download_failed', 'failed_new')) AS download_failed, count(*) FILTER (step = 'parse_failed') AS parse_failed, count(*) FILTER (step = 'indexed') AS indexed FROM states""",
    "document_details": f"WITH {_ATTACHMENT_DOCS} SELECT d.doc_id AS attachment_id, coalesce(p.title, d.parent_title) AS parent, length(file_text) AS text_length, length(substr(file_text, 1, 2000)) AS preview_length FROM docs d LEFT JOIN pages p ON p.id = d.parent_page_id",
    "filter_usage": """WITH f AS (SELECT filters, CASE WHEN json_valid(filters) AND json_type(filters) = 'OBJECT' THEN json_keys(filters) ELSE [] END AS ks FROM query_logs WHERE filters IS NOT NULL),
e AS (SELECT filters, unnest(CASE WHEN len(ks) > 0 THEN ks ELSE [NULL] END) AS k FROM f)
SELECT k AS filter_key, CASE WHEN k IS NOT NULL THEN json_extract_string(filters, '$."' || k || '"') END AS filter_value, count(*) AS cnt FROM e GROUP BY ALL""",
    "cleaned_texts": r"""SELECT item_id, array_to_string(list_filter([trim(regexp_replace(l, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) for l in regexp_split_to_array(content, '\r\n|\r|\n')], lambda x: x <> ''), chr(10)) AS content,
  coalesce(array_to_string(anchor_texts, ' '), '') AS anchor_text FROM page_items""",
    "frontier": f"WITH {_new_links('SELECT from_url AS url, to_url AS href FROM page_links')} SELECT url FROM k WHERE url NOT IN (SELECT normalized_url FROM pages WHERE normalized_url IS NOT NULL)",
    "frontier_html": f"WITH {_new_links(_HREFS.format(url='url'))} SELECT url FROM k WHERE url NOT IN (SELECT normalized_url FROM pages WHERE normalized_url IS NOT NULL)",
    "crawl_depths": f"""WITH RECURSIVE hr AS ({_HREFS.format(url=_norm('url'))}), edges AS (SELECT DISTINCT here, url AS there FROM (SELECT DISTINCT url AS here, href FROM hr) x, LATERAL (WITH {_new_links('SELECT x.here AS url, x.href AS href')} SELECT url FROM k)),
s0 AS (SELECT DISTINCT {_norm('url')} AS url, 0 AS depth FROM pages WHERE id % 50 = 0),
s1 AS (SELECT DISTINCT there AS url, 1 AS depth FROM edges JOIN s0 ON here = s0.url WHERE there NOT IN (SELECT url FROM s0)),
s2 AS (SELECT DISTINCT there AS url, 2 AS depth FROM edges JOIN s1 ON here = s1.url WHERE there NOT IN (SELECT url FROM s0 UNION ALL SELECT url FROM s1))
SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2""",
    "crawl_seeds": f"WITH {_SITES} SELECT site, unnest(start_urls) AS url FROM sites",
    "crawl_plan": f"WITH {_SITES} SELECT count(*) AS batches, count(DISTINCT site) AS sites, cast(sum(max_pages) AS BIGINT) AS max_pages FROM sites",
    "sites_of_urls": f"WITH {_SITES}, d AS (SELECT site, unnest(domains) AS d FROM sites) SELECT id, (SELECT min(site) FROM d WHERE contains(lower({_host('url')}), d)) AS site FROM pages",
    "parsed_pages": rf"""SELECT item_id, coalesce({_TITLE.format(tag='title').replace(chr(92) + 's+', _WHITE)}, {_TITLE.format(tag='h1').replace(chr(92) + 's+', _WHITE)}, '') AS title, coalesce(len(regexp_extract_all(raw_html, '(?is)<a\s[^<>]*?href=[^<>]*>')), 0) AS links,
  coalesce(strftime(try_strptime(regexp_extract(raw_html, '(?i)<meta name="pubdate" content="([^"]*)"', 1), '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%d %H:%M'), {_scan(f"substr({_TEXT}, 1, 8192)", '%Y-%m-%d %H:%M')}) AS published FROM page_items""",
    "crawled_items": rf"""WITH {_SITES}, d AS (SELECT site, category, unnest(domains) AS d FROM sites),
t AS (SELECT *, substr(sha256(url), 1, 16) AS s FROM page_items WHERE item_id % 9 <> 0 AND length(regexp_replace({_TEXT}, '\s+', '', 'g')) >= 50)
SELECT url, {_norm('url')} AS normalized_url, coalesce({_TITLE.format(tag='h1').replace(chr(92) + 's+', _WHITE)}, {_TITLE.format(tag='title').replace(chr(92) + 's+', _WHITE)}, '') AS title,
  coalesce((SELECT min(site) FROM d WHERE contains(lower({_host('url')}), d)), '') AS source_site, coalesce((SELECT min_by(category, site) FROM d WHERE contains(lower({_host('url')}), d)), '') AS category,
  '{AS_OF.isoformat()}' AS crawl_time, 'snapshots/' || substr(s, 1, 2) || '/' || substr(s, 3, 2) || '/' || s || '.html' AS snapshot_path, status_code,
  len(regexp_extract_all(raw_html, '(?is)<a\s[^<>]*?href=[^<>]*>')) AS anchors, len(regexp_extract_all(raw_html, '(?is)<a\s[^<>]*?href="[^"#?]*\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar)"[^<>]*>')) AS attachments FROM t""",
    "scanned_dates": f"SELECT item_id, {_scan('content', '%Y-%m-%d %H:%M:%S')} AS any, {_scan('content', '%Y-%m-%d %H:%M:%S', (1, 2, 5, 6))} AS crawl FROM page_items",
    "recent_with_total": "WITH t AS (SELECT DISTINCT * FROM query_logs) SELECT id, query_text, query_type, result_count, created_at, (SELECT count(*) FROM t) AS total FROM t ORDER BY created_at DESC, id DESC LIMIT 10",
    "items_roundtrip": "SELECT url, title, length(content) AS chars, content_hash, len(out_links) AS links, publish_time, status_code, 15 AS keys, 'item' AS kind FROM page_items",
    "snapshot_files": r"""WITH l AS (SELECT url, arg_max(raw_html, item_id) AS raw_html, substr(sha256(url), 1, 16) AS s FROM page_items WHERE raw_html <> '' AND url IS NOT NULL GROUP BY url)
SELECT url, 'snapshots/' || substr(s, 1, 2) || '/' || substr(s, 3, 2) || '/' || s || '.html' AS snapshot_path, strlen(raw_html) AS bytes, sha256(raw_html) AS hash FROM l""",
    "distinct_links": "SELECT item_id, len(list_distinct(coalesce(out_links, []))) AS links, out_links[1] AS first FROM page_items",
    "ingest_first_lines": f"WITH {_DECIDE.format(force='false').replace('FROM page_items)', 'FROM (SELECT * FROM page_items ORDER BY item_id LIMIT 200))')} SELECT line_no, action FROM decided",
    "attachment_dry_run": f"""WITH {_STATES} SELECT count(*) FILTER (step <> 'ignored') AS found, count(*) FILTER (step NOT IN ('ignored', 'skip')) AS "new", count(*) FILTER (step = 'skip') AS skipped,
  count(*) FILTER (step NOT IN ('ignored', 'skip')) AS downloaded, count(*) FILTER (step NOT IN ('ignored', 'skip')) AS indexed FROM states""",
    "attachment_decide": f"WITH {_ATTACHED} SELECT item_id, pos, action FROM decided",
    "attachment_upsert": f"""WITH {_ATTACHED}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY item_id DESC, pos DESC) AS r2 FROM decided WHERE action IN ('insert', 'update')) WHERE r2 = 1),
st AS (SELECT id, normalized_file_url AS sk, parent_title, content_hash FROM attachments WHERE normalized_file_url <> '')
SELECT coalesce(sk, nk) AS normalized_file_url, CASE WHEN nk IS NULL THEN parent_title WHEN sk IS NULL THEN coalesce(l.title, '') ELSE l.title END AS title,
  CASE WHEN nk IS NULL THEN st.content_hash WHEN sk IS NULL THEN coalesce(l.content_hash, '') ELSE l.content_hash END AS content_hash, coalesce(action, 'keep') AS action FROM st FULL JOIN last l ON nk = sk""",
    "search_unindexed": f"WITH {_multi(_PAGE_DOCS, Q, PAGE_BOOSTS)} SELECT doc_id AS page_id, round(score, 6) AS score FROM hits",
    "search_phrase_unindexed": f"WITH {_phrase(PHRASE, {'title': 4.0, 'content': 1.0})} SELECT doc_id AS page_id, round(score, 6) AS score FROM hits",
    "refreshed_index": f"WITH {_PAGE_DOCS}, {_fields(['title', 'content'])} SELECT term, field, count(*) AS df FROM (SELECT field, unnest(list_distinct(toks)) AS term FROM fields) GROUP BY ALL",
    "get_many": f"WITH {_PAGE_DOCS} SELECT c.page_id, coalesce(title, '') AS title, coalesce(anchor_text, '') AS anchor_text FROM (SELECT DISTINCT id AS page_id FROM page_links) c LEFT JOIN docs ON doc_id = c.page_id",
}
