"""The operators' registered queries, with production parameters on whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import html_extraction, jaccard, language_id, mixing, packing, ppm, quality, topk_search, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify_language(docs, language_id.train_language_model(docs))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.find_toxic(docs, toxicity.train_toxicity_model(docs, _table(spark, sf_dir, "labels")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality_model(docs, _table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk_search, op2_language_id, op3_html_extraction, op4_ngram_jaccard, op5_toxicity, op6_source_mixing, op7_url_filter, op8_quality_rules, op9_packing, op10_ppm_scoring)
}

_ENTRIES = ", ".join(f"('{e}')" for e in sorted(url_filter.BLOCKLIST))

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """
WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN min(embedding)] AS e FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 9) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbor_id, CAST(r AS INTEGER) AS rank, s AS score
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbor_id) AS r FROM s) WHERE r <= 10""",
    "op4_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS g FROM w),
r AS (SELECT row_number() OVER (ORDER BY min(doc_id), g) AS s, g, min(doc_id) AS rep, count(*) - 1 AS n_copies, len(g) AS size FROM g WHERE len(g) > 0 GROUP BY g),
t AS (SELECT s, size, unnest(g) AS t FROM r),
o AS (SELECT a.s AS a, b.s AS b FROM t a JOIN t b ON a.t = b.t AND a.s <> b.s GROUP BY a.s, b.s, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.5),
c(s, m) AS (SELECT s, s FROM r UNION SELECT c.s, o.b FROM c JOIN o ON c.m = o.a),
k AS (SELECT c.s, min(m.rep) AS class_id FROM c JOIN r m ON c.m = m.s GROUP BY c.s),
l AS (SELECT a AS s, count(*) AS n_links FROM o GROUP BY a)
SELECT g.doc_id, k.class_id, coalesce(l.n_links, 0) AS n_links, r.n_copies FROM g JOIN r ON g.g = r.g JOIN k ON r.s = k.s LEFT JOIN l ON r.s = l.s
UNION ALL SELECT doc_id, doc_id, 0, 0 FROM g WHERE len(g) = 0""",
    "op6_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 0) AS BIGINT) AS n_tokens,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM d GROUP BY source HAVING sum(n_tokens) > 0),
b AS (SELECT source, total, CAST(floor((SELECT sum(total) FROM s)::DOUBLE * 1.0::DOUBLE / (SELECT count(*) FROM s)::DOUBLE) AS BIGINT) AS budget FROM s),
p AS (SELECT d.doc_id, d.source, d.n_tokens, CAST(sum(d.n_tokens) OVER (PARTITION BY d.source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - d.n_tokens AS BIGINT) AS start_token,
    budget // total AS epochs, budget % total AS rest FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
c AS (SELECT *, epochs + CASE WHEN rest > 0 AND start_token + n_tokens <= rest THEN 1 ELSE 0 END AS copies,
    CASE WHEN NOT (rest > 0 AND start_token + n_tokens <= rest) AND start_token < rest THEN rest - start_token ELSE 0 END AS cut FROM p),
e AS (SELECT *, unnest(range(copies + CASE WHEN cut > 0 THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, start_token, n_tokens, CAST(CASE WHEN epoch = copies AND cut > 0 THEN cut ELSE n_tokens END AS BIGINT) AS take_tokens FROM e""",
    "op7_url_filter": rf"""
WITH l(e) AS (VALUES {_ENTRIES}),
u AS (SELECT row_number() OVER () AS r, page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS h,
    rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS p FROM pages),
m AS (SELECT r, e, contains(e, '/') AS deep FROM u JOIN l ON h <> '' AND CASE WHEN contains(e, '/') THEN h || p = e OR starts_with(h || p, e || '/') ELSE h = e OR (NOT regexp_full_match(h, '[0-9.]+') AND ends_with(h, '.' || e)) END),
b AS (SELECT r, e FROM (SELECT r, e, row_number() OVER (PARTITION BY r ORDER BY deep DESC, length(e) DESC) AS k FROM m) WHERE k = 1)
SELECT page_id, url, e IS NOT NULL AS blocked, e AS entry FROM u LEFT JOIN b USING (r)""",
}
