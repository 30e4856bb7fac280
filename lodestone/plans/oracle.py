"""DuckDB SQL for the engine's queries: the same relations, stated a second time and independently of Spark."""

from __future__ import annotations

PLAIN = "[0-9]{1,100}|[A-Za-z]{1,100}"
BLANK = r" \t\n\r\f\x0B"
STEM = "CASE WHEN {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' WHEN {t} LIKE '%es' THEN left({t}, length({t}) - 2) WHEN {t} LIKE '%s' THEN left({t}, length({t}) - 1) ELSE {t} END"


def _stemmed(t: str, stem: bool) -> str:
    return STEM.format(t=t) if stem else t


DOCS = "docs AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS name, '' AS title, text FROM documents)"
RAW_PLAIN = f"raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PLAIN}')) AS t FROM docs)"
UNSCRIPTED = r"regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script.*?(</script>|\z)', ' ', 'g'), '(?s)<style.*?(</style>|\z)', ' ', 'g')"
BODY = rf"regexp_replace(regexp_replace({UNSCRIPTED}, '(?s)<title>[^<]*(<[^>]*>?|\z)', ' ', 'g'), '<[^>]*(>|\z)', ' ', 'g')"
RAW_TITLE = f"coalesce(list_filter(regexp_extract_all({UNSCRIPTED}, '(?s)<title>([^<]*)<', 1), lambda t: t <> '')[1], '')"
TITLE = f"left(replace(replace(replace({RAW_TITLE}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), 100)"
HTML_DOCS = f"docs AS (SELECT page_id AS doc_id, url AS name, {TITLE} AS title FROM pages)"
RAW_HTML = f"raw AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(regexp_replace({BODY}, '&[A-Za-z0-9#]{{1,31}};', '', 'g'), '[^{BLANK}<]{{1,100}}')) AS t FROM pages)"


def tokens(stem: bool = False, html: bool = False) -> str:
    """tok(doc_id, term), one row for each occurrence."""
    docs, raw = (HTML_DOCS, RAW_HTML) if html else (DOCS, RAW_PLAIN)
    return f"""{docs}, {raw},
low AS (SELECT doc_id, lower(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l FROM raw),
tok AS MATERIALIZED (SELECT doc_id, term FROM (SELECT doc_id, {_stemmed("l", stem)} AS term FROM low) WHERE term <> '')"""


def scores(stem: bool = False, html: bool = False) -> str:
    return f"""{tokens(stem, html)},
tf AS MATERIALIZED (SELECT term, doc_id, CAST(least(count(*), 255) AS INTEGER) AS tf FROM tok GROUP BY term, doc_id),
dl AS (SELECT doc_id, name, title, CAST(coalesce(n, 0) AS INTEGER) AS len FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) USING (doc_id)),
st AS (SELECT count(*) AS n, sum(len)::DOUBLE / count(*)::DOUBLE AS l, max(len) AS longest FROM dl),
df AS (SELECT term, CAST(count(*) AS INTEGER) AS df FROM tf GROUP BY term),
sc AS MATERIALIZED (SELECT term, doc_id, tf, ln(n::DOUBLE / df::DOUBLE) * (0.9::DOUBLE + 1.0::DOUBLE) * tf / (0.9::DOUBLE * (1.0::DOUBLE - 0.4::DOUBLE + 0.4::DOUBLE * (len::DOUBLE / l)) + tf) AS s
  FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st)"""


def impacts(stem: bool = False, html: bool = False) -> str:
    return f"""{scores(stem, html)},
mm AS (SELECT min(s) AS lo, max(s) AS hi FROM sc),
imp AS MATERIALIZED (SELECT term, doc_id, tf, CASE WHEN hi = lo THEN 1 ELSE CAST(floor((s - lo) / (hi - lo) * 254.0::DOUBLE) + 1 AS INTEGER) END AS impact FROM sc CROSS JOIN mm),
hd AS MATERIALIZED (SELECT term, impact, count(*) AS len FROM imp WHERE impact > 0 GROUP BY term, impact)"""


def asked(queries: str, stem: bool = False) -> str:
    """qt(qid, term, cnt) from a table expression of qid, query."""
    return f"""qq AS (SELECT qid, lower(unnest(regexp_extract_all(query, '[0-9]+|[A-Za-z]+'))) AS l FROM ({queries})),
qt AS (SELECT qid, term, CAST(count(*) AS INTEGER) AS cnt FROM (SELECT qid, {_stemmed("l", stem)} AS term FROM qq) WHERE term <> '' GROUP BY qid, term)"""


def one(query: str) -> str:
    return f"SELECT 0::BIGINT AS qid, '{query}' AS query"


BATCH = "SELECT item_id AS qid, text AS query FROM benchmark"


def kept(queries: str, exhaustive: bool = False, stem: bool = False, html: bool = False, index: str | None = None) -> str:
    """c(qid, term, impact, len, weight, n_terms, score): the segments searched and what their documents get."""
    everything = "TRUE" if exhaustive else "n_terms = 1 OR coalesce(before, 0) < greatest(1, CAST(floor(0.1::DOUBLE * (SELECT n FROM st)) AS BIGINT))"
    return f"""{index or impacts(stem, html)}, {asked(queries, stem)},
m AS (SELECT qid, term, impact, len, cnt, impact * cnt AS weight FROM hd JOIN qt USING (term)),
n AS (SELECT qid, count(DISTINCT term) AS n_terms FROM m GROUP BY qid),
o AS (SELECT m.*, n_terms, sum(len) OVER (PARTITION BY qid ORDER BY weight DESC, len, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m JOIN n USING (qid)),
k AS (SELECT * FROM o WHERE {everything}),
b AS (SELECT qid, count(*) AS terms, sum(best) AS total FROM (SELECT qid, term, max(weight) AS best FROM k GROUP BY qid, term) GROUP BY qid),
c AS (SELECT qid, term, impact, len, weight, n_terms, CAST(CASE WHEN n_terms = 1 THEN weight ELSE floor(1.0::DOUBLE + weight::DOUBLE * (255 - terms)::DOUBLE / total::DOUBLE) END AS INTEGER) AS score FROM k JOIN b USING (qid))"""


def found(queries: str, k: int = 10, offset: int = 0, **how) -> str:
    """hits(qid, rank, doc_id, score)."""
    return f"""{kept(queries, **how)},
acc AS (SELECT qid, doc_id, CAST(sum(score) AS INTEGER) AS score FROM c JOIN imp USING (term, impact) GROUP BY qid, doc_id),
hits AS MATERIALIZED (SELECT qid, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM acc) WHERE rank > {offset} AND rank <= {offset + k})"""


def named(queries: str, **how) -> str:
    return f"WITH {found(queries, **how)} SELECT rank, doc_id, score, name, title FROM hits JOIN docs USING (doc_id)"


def windows(query: str, k: int) -> str:
    """w(qid, doc_id, pos, n, t, hit, h) for the words of the documents found, and start(qid, doc_id, best, start)."""
    return f"""{found(one(query), k)},
words AS (SELECT h.qid, h.doc_id, unnest(regexp_extract_all(d.text, '{PLAIN}')) AS t, generate_subscripts(regexp_extract_all(d.text, '{PLAIN}'), 1) - 1 AS pos, len(regexp_extract_all(d.text, '{PLAIN}')) AS n FROM hits h JOIN docs d USING (doc_id)),
flag AS (SELECT *, lower(regexp_replace(t, '[^A-Za-z]', '', 'g')) IN (SELECT term FROM qt) AS hit FROM words),
w AS (SELECT *, sum(hit::INTEGER) OVER (PARTITION BY qid, doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS h FROM flag),
opening AS (SELECT qid, doc_id, max(h) FILTER (pos = least(100, n) - 1) AS first_h, max(h) FILTER (pos >= 100) AS top_h FROM w GROUP BY qid, doc_id),
best AS (SELECT w.qid, w.doc_id, coalesce(min(pos) FILTER (pos >= 100 AND top_h > first_h AND h = top_h), 0) AS best FROM w JOIN opening USING (qid, doc_id) GROUP BY w.qid, w.doc_id),
start AS (SELECT qid, doc_id, CAST(best AS INTEGER) AS best, CAST(CASE WHEN best = 0 THEN 0 ELSE greatest(1, coalesce(max(pos + 1) FILTER (t LIKE '%.' AND pos + 1 <= best), 1)) END AS INTEGER) AS start FROM w JOIN best USING (qid, doc_id) GROUP BY qid, doc_id, best)"""
