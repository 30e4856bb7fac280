"""The registered queries of the search engine, one or more for each operator, and SQL for all that SQL can express."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.functions import codecs
from lodestone.functions.text import s_stem
from lodestone.operators import expansion, indexing, results, search, snippets, stats
from lodestone.plans import oracle
from lodestone.plans.indexes import document_index, html_corpus, page_index, plain_corpus
from lodestone.plans.session import stored, workspace
from lodestone.sources import documents, interchange
from lodestone.streaming.service import answer_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

STEMMED = replace(DEFAULT, stemmer="s")
TEXT = "The ouon worthless and and eden zzzz 42"
STEM_TEXT = "es inesea thes ouons reres this"
PAGE_TEXT = "the sch enau worthless que"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "qid long, query string")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _terms(corpus: DataFrame) -> DataFrame:
    return indexing.document_terms(corpus).select("doc_id", F.explode("terms").alias("term"))


@query(f"WITH {oracle.tokens()} SELECT term, count(*) AS n FROM tok GROUP BY term")
def tok_plain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(plain_corpus(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {oracle.tokens(html=True)} SELECT term, count(*) AS n FROM tok GROUP BY term")
def tok_html_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(html_corpus(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {oracle.TITLE} AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_corpus(spark, sf_dir).select(F.col("doc_id").alias("page_id"), "title")


@query(f"WITH {oracle.tokens()}, v AS (SELECT DISTINCT term FROM tok) SELECT term, {oracle.STEM.format(t='term')} AS stemmed FROM v")
def stem_s_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).vocab.select("term", s_stem(F.col("term")).alias("stemmed"))


@query(f"WITH {oracle.asked(oracle.BATCH)} SELECT * FROM qt")
def query_parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.parse_queries(_batch(spark, sf_dir), DEFAULT)


@query("""WITH l AS (SELECT CASE WHEN item_id % 3 = 0 THEN text ELSE CAST(item_id AS VARCHAR) || ' ' || text END AS line FROM benchmark)
SELECT coalesce(TRY_CAST(regexp_extract(line, '^([0-9]+) ', 1) AS BIGINT), 0)::BIGINT AS qid,
  CASE WHEN TRY_CAST(regexp_extract(line, '^([0-9]+) ', 1) AS BIGINT) IS NOT NULL THEN regexp_replace(line, '^[0-9]+ ', '') ELSE line END AS query FROM l""")
def topic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three benchmark items as numbered lines, the others as lines that are all query."""
    line = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat_ws(" ", F.col("item_id").cast("string"), "text"))
    return documents.parse_topics(_table(spark, sf_dir, "benchmark").select(line.alias("line")))


@query("SELECT page_id, url AS name FROM pages")
def base64_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read back from base64 file names. A slash of the alphabet can't be in a file name, so names that need one are kept."""
    stem = F.regexp_replace(F.base64(F.encode("url", "utf-8")), "[\\r\\n]", "")
    name = F.when(stem.contains("/"), F.col("url")).otherwise(documents.decode_name(F.concat(F.lit("folder.x/"), stem, F.lit(".html"))))
    return _table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


@query(f"WITH {oracle.scores()} SELECT term, doc_id, tf FROM tf")
def term_freq_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).postings.select("term", "doc_id", "tf")


@query(f"WITH {oracle.scores()} SELECT term, df FROM df")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).vocab


@query(f"WITH {oracle.scores()} SELECT doc_id, len FROM dl")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).docs.select("doc_id", "len")


@query(f"WITH {oracle.scores()} SELECT n AS n_docs, round(l, 6) AS avg_len, longest AS max_doc_len FROM st")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).meta.select("n_docs", F.round("avg_len", 6).alias("avg_len"), "max_doc_len")


@query(f"WITH {oracle.scores()} SELECT term, round(ln(n::DOUBLE / df::DOUBLE), 6) AS idf FROM df CROSS JOIN st")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    return index.vocab.select("term", F.round(indexing.idf(F.lit(index.n_docs), F.col("df")), 6).alias("idf"))


@query(f"WITH {oracle.scores()} SELECT term, doc_id, round(s, 6) AS score FROM sc")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).scores.select("term", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {oracle.scores()} SELECT round(min(s), 6) AS min_rsv, round(max(s), 6) AS max_rsv FROM sc")
def rsv_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).meta.select(F.round("min_rsv", 6).alias("min_rsv"), F.round("max_rsv", 6).alias("max_rsv"))


@query(f"WITH {oracle.impacts()} SELECT term, doc_id, impact FROM imp")
def quantised_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).postings.select("term", "doc_id", "impact")


@query(f"WITH {oracle.impacts()} SELECT term, impact, len FROM hd")
def segment_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).headers


@query(f"WITH {oracle.impacts()} SELECT term, impact, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS docs FROM imp GROUP BY term, impact, doc_id // 65536")
def segment_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).segments.select("term", "impact", F.array_join(F.transform("docs", lambda d: d.cast("string")), " ").alias("docs"))


@query(f"WITH {oracle.impacts()} SELECT impact, max(len) AS most FROM hd GROUP BY impact")
def segment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.segment_histogram(document_index(spark, sf_dir))


@query(f"WITH {oracle.impacts()} SELECT term, impact, doc_id, CAST(doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, impact ORDER BY doc_id) AS INTEGER) AS gap FROM imp")
def segment_dgaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.segment_gaps(document_index(spark, sf_dir).segments)


@query(f"""WITH {oracle.impacts()}, g AS (SELECT term, impact, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, impact ORDER BY doc_id) AS gap FROM imp)
SELECT term, impact, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS bytes FROM g GROUP BY term, impact""")
def vbyte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = codecs.segment_gaps(document_index(spark, sf_dir).segments)
    return gaps.groupBy("term", "impact").agg(F.sum(codecs.vbyte_size(F.col("gap"))).alias("bytes"))


@query(f"WITH {oracle.kept(oracle.one(TEXT), exhaustive=True)} SELECT term, impact, len, weight FROM m")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    return search.matched(index, search.parse_queries(_one(spark, TEXT), index.config)).select("term", "impact", "len", "weight")


@query(f"WITH {oracle.kept(oracle.BATCH)} SELECT qid, term, impact, len, weight FROM c")
def prune_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    return search.prune(index, search.matched(index, search.parse_queries(_batch(spark, sf_dir), index.config))).select("qid", "term", "impact", "len", "weight")


@query(f"WITH {oracle.kept(oracle.BATCH)} SELECT qid, term, impact, score FROM c")
def rescaled_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    kept = search.prune(index, search.matched(index, search.parse_queries(_batch(spark, sf_dir), index.config)))
    return search.rescale(kept, index.config).select("qid", "term", "impact", "score")


@query(oracle.named(oracle.one(TEXT), exhaustive=True))
def search_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(document_index(spark, sf_dir), TEXT, exhaustive=True)


@query(oracle.named(oracle.one(TEXT)))
def search_anytime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(document_index(spark, sf_dir), TEXT)


@query(oracle.named(oracle.one("worthless zzzz")))
def search_single_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(document_index(spark, sf_dir), "worthless zzzz")


@query(oracle.named(oracle.one("worthless Worthless worthless")))
def search_repeated_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(document_index(spark, sf_dir), "worthless Worthless worthless")


@query(oracle.named(oracle.one(TEXT), offset=10))
def search_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(document_index(spark, sf_dir), TEXT, offset=10)


@query(oracle.named(oracle.one("zzzzqqqq 42")))
def search_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(document_index(spark, sf_dir), "zzzzqqqq 42")


@query(oracle.named(oracle.one(STEM_TEXT), stem=True))
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(document_index(spark, sf_dir, STEMMED), STEM_TEXT)


@query(f"WITH {oracle.found(oracle.BATCH)} SELECT * FROM hits")
def search_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_batch(document_index(spark, sf_dir), _batch(spark, sf_dir))


@query(f"WITH {oracle.found(oracle.BATCH, k=1000, exhaustive=True)} SELECT * FROM hits")
def search_batch_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_batch(document_index(spark, sf_dir), _batch(spark, sf_dir), k=1000, exhaustive=True)


@query(f"WITH {oracle.found(oracle.BATCH)} SELECT printf('%d Q0 %s %d %d %s', qid, name, rank, score, 'lodestone') AS line FROM hits JOIN docs USING (doc_id)")
def trec_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    return results.run_lines(index, search.search_batch(index, _batch(spark, sf_dir)))


@query(oracle.named(oracle.one(PAGE_TEXT), html=True))
def search_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(page_index(spark, sf_dir), PAGE_TEXT)


def _found(spark: SparkSession, sf_dir: str, k: int = 50):
    index = document_index(spark, sf_dir)
    terms = search.parse_queries(_one(spark, TEXT), index.config)
    return index, stored(search.search_terms(index, terms, k), "hits"), terms


@query(f"WITH {oracle.windows(TEXT, 50)} SELECT doc_id, CAST(pos AS INTEGER) AS pos, hit FROM flag")
def snippet_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.hit_rows(*_found(spark, sf_dir)).select("doc_id", "pos", "hit")


@query(f"WITH {oracle.windows(TEXT, 50)} SELECT doc_id, best, start FROM start")
def snippet_best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.best_windows(*_found(spark, sf_dir)).select("doc_id", "best", "start")


@query(f"""WITH {oracle.windows(TEXT, 50)} SELECT doc_id, string_agg(CASE WHEN hit THEN '<b>' || t || '</b>' ELSE t END, ' ' ORDER BY pos) AS snippet
FROM w JOIN start USING (qid, doc_id) WHERE pos >= start AND pos < start + 100 GROUP BY doc_id""")
def snippet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.snippets(*_found(spark, sf_dir)).select("doc_id", "snippet")


@query(f"""WITH {oracle.windows(TEXT, 50)}, sn AS (SELECT doc_id, string_agg(CASE WHEN hit THEN chr(27) || '[1m' || t || chr(27) || '[0m' ELSE t END, ' ' ORDER BY pos) AS snippet
FROM w JOIN start USING (qid, doc_id) WHERE pos >= start AND pos < start + 100 GROUP BY doc_id)
SELECT rank, score::VARCHAR || ' ' || name || coalesce(chr(10) || snippet, '') AS text FROM hits JOIN docs USING (doc_id) LEFT JOIN sn USING (doc_id)""")
def result_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, hits, terms = _found(spark, sf_dir)
    return results.listing(index, hits, snippets.snippets(index, hits, terms, "\x1b[1m", "\x1b[0m")).select("rank", "text")


_SYNONYM_QUERIES = "VALUES (1::BIGINT, 'dal'), (1::BIGINT, 'soup'), (2::BIGINT, 'spinach'), (2::BIGINT, 'saag'), (3::BIGINT, 'plain')"


@query(f"""WITH t(qid, term) AS ({_SYNONYM_QUERIES}), s(grp, member) AS (VALUES {", ".join(f"('{g}', '{t}')" for g, ts in expansion.GROUPS for t in ts.split())})
SELECT qid, term FROM t UNION SELECT qid, b.member FROM t JOIN s a ON term = a.member JOIN s b ON a.grp = b.grp""")
def query_expand_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.expand(spark.createDataFrame([(1, "dal"), (1, "soup"), (2, "spinach"), (2, "saag"), (3, "plain")], "qid long, term string"))


@query(f"""WITH {oracle.impacts()} SELECT 'documents' AS metric, count(*) AS value FROM dl UNION ALL SELECT 'longest_document', max(len)::BIGINT FROM dl
UNION ALL SELECT 'terms', count(*) FROM df UNION ALL SELECT 'postings', sum(df)::BIGINT FROM df UNION ALL SELECT 'segments', count(*) FROM hd""")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(document_index(spark, sf_dir))


@query(f"WITH {oracle.scores(html=True)} SELECT term, df FROM df")
def stats_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.terms(page_index(spark, sf_dir))


@query(f"WITH {oracle.HTML_DOCS} SELECT * FROM docs")
def stats_docids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.names(page_index(spark, sf_dir))


@query(f"WITH {oracle.impacts()} SELECT term, doc_id, impact FROM imp")
def interchange_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' index written in the interchange format, read again, and scored and quantised anew."""
    return interchange.import_index(spark, _exported(spark, sf_dir), quantised=True).postings.select("term", "doc_id", "impact")


_AS_IS = f"{oracle.scores()}, imp AS MATERIALIZED (SELECT term, doc_id, tf, tf AS impact FROM tf), hd AS MATERIALIZED (SELECT term, impact, count(*) AS len FROM imp GROUP BY term, impact)"


@query(f"WITH {oracle.found(oracle.one(TEXT), index=_AS_IS)} SELECT rank, doc_id, score FROM hits")
def interchange_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in an imported index whose frequencies are its impacts."""
    index = interchange.import_index(spark, _exported(spark, sf_dir))
    return search.search(index, TEXT).select("rank", "doc_id", "score")


def _exported(spark: SparkSession, sf_dir: str) -> str:
    path = f"{workspace(spark)}/{uuid.uuid4().hex}.ciff"
    interchange.export_index(document_index(spark, sf_dir), path)
    return path


@query(f"WITH {oracle.found(oracle.BATCH)} SELECT * FROM hits")
def search_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's queries as a stream, answered batch by batch."""
    table = _table(spark, sf_dir, "benchmark")
    reader = spark.readStream.schema(table.schema)
    if all(f.endswith("/benchmark.parquet") for f in table.inputFiles()):  # a stream reads folders; here the table is one file
        source = reader.option("pathGlobFilter", "benchmark.parquet").parquet(sf_dir)
    else:
        source = reader.parquet(f"{sf_dir}/benchmark.parquet")
    stream = source.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    out = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"
    answer_stream(document_index(spark, sf_dir), stream, f"{out}/answers", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/answers").select("qid", "rank", "doc_id", "score")
