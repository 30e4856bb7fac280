"""Snippets: the window of words with most hits, from the start of its sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalise
from lodestone.operators.indexing import Index


def words_of(index: Index, hits: DataFrame) -> DataFrame:
    """doc_id, tokens of the documents found. As many ids as one query can find are named to the scan, so that the other
    documents' words are not even cut out of their texts; more ids are joined."""
    ids, most = hits.select("doc_id").distinct(), index.config.max_k
    named = [r["doc_id"] for r in ids.limit(most + 1).collect()]
    if len(named) <= most:
        return index.doc_tokens.filter(F.col("doc_id").isin(named))
    return index.doc_tokens.join(ids, "doc_id", "left_semi")


def hit_rows(index: Index, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, doc_id, pos, n, original, hit: the words of the documents found; a hit is a word whose index term the query has."""
    asked = terms.groupBy("qid").agg(F.collect_set("term").alias("terms"))
    rows = hits.select("qid", "doc_id").join(words_of(index, hits), "doc_id").join(asked, "qid")
    words = rows.select("qid", "doc_id", F.size("tokens").alias("n"), "terms", F.posexplode("tokens").alias("pos", "original"))
    return words.select("qid", "doc_id", "pos", "n", "original", F.array_contains("terms", normalise(F.col("original"), index.config.stemmer)).alias("hit"))


def best_windows(index: Index, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, doc_id, best, start: where the first window of most hits is found, and the start of the sentence before.

    best is 0 if the document's first window is as good as any, otherwise the last position of the first better one. From
    there the start goes back until the word before ends a sentence, to 1 at the least.
    """
    size = index.config.snippet_window
    order = Window.partitionBy("qid", "doc_id").orderBy("pos")
    rows = hit_rows(index, hits, terms).withColumn("hits", F.sum(F.col("hit").cast("int")).over(order.rowsBetween(-(size - 1), 0)))
    doc = Window.partitionBy("qid", "doc_id")
    opening = F.max(F.when(F.col("pos") == F.least(F.lit(size), F.col("n")) - 1, F.col("hits"))).over(doc)
    top = F.max(F.when(F.col("pos") >= size, F.struct("hits", -F.col("pos")))).over(doc)
    best = F.when(top.isNotNull() & (top["hits"] > opening), -top["col2"]).otherwise(0)
    rows = rows.withColumn("best", best)
    sentence = F.when(F.col("original").endswith(".") & (F.col("pos") + 1 <= F.col("best")), F.col("pos") + 1)
    start = F.when(F.first("best") == 0, 0).otherwise(F.greatest(F.coalesce(F.max(sentence), F.lit(1)), F.lit(1)))
    return rows.groupBy("qid", "doc_id").agg(F.first("best").cast("int").alias("best"), start.cast("int").alias("start"))


def snippets(index: Index, hits: DataFrame, terms: DataFrame, before: str = "<b>", after: str = "</b>") -> DataFrame:
    """qid, doc_id, snippet: up to a window of words with the hits marked; '' where an index has no words to show."""
    if index.doc_tokens is None:
        return hits.select("qid", "doc_id", F.lit("").alias("snippet"))
    asked = terms.groupBy("qid").agg(F.collect_set("term").alias("terms"))
    rows = hits.select("qid", "doc_id").join(best_windows(index, hits, terms), ["qid", "doc_id"], "left").join(words_of(index, hits), "doc_id", "left").join(asked, "qid")
    shown = F.slice("tokens", F.coalesce("start", F.lit(0)) + 1, index.config.snippet_window)
    return rows.select("qid", "doc_id", F.coalesce(F.array_join(F.transform(shown, lambda t: _marked(t, F.col("terms"), index.config.stemmer, before, after)), " "), F.lit("")).alias("snippet"))


def _marked(token: Column, terms: Column, stemmer: str, before: str, after: str) -> Column:
    return F.when(F.array_contains(terms, normalise(token, stemmer)), F.concat(F.lit(before), token, F.lit(after))).otherwise(token)
